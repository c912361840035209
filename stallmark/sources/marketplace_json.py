"""JSON pages of marketplaces to listings: explicit schemas, parsing and projections in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import look_up, plain_number
from .typed_json import FLAG, NUMBER, TEXT, Shape, at, checked, entries, kind_of, problems, read

MARKET_DATA = "array<struct<productId:string,variantId:string,currencyCode:string,highestBidAmount:string,lowestAskAmount:string>>"


def _all_text(names: str, **more: str | Shape) -> dict[str, str | Shape]:
    return dict.fromkeys(names.split(), TEXT) | more


_AMOUNT = Shape(optional=_all_text("value currency"))
#: Fields of an item of a search page that are read.
SEARCH_ITEM = Shape(
    required=("itemId", "title", "itemWebUrl"),
    optional=_all_text(
        "legacyItemId subtitle shortDescription itemAffiliateWebUrl itemHref itemGroupType epid listingMarketplaceId condition conditionId itemCreationDate itemEndDate unitPricingMeasure",
        price=Shape(required=("value",), optional={"currency": TEXT}),
        itemLocation=Shape(optional=_all_text("city stateOrProvince postalCode country")),
        image=Shape(optional={"imageUrl": TEXT}),
        seller=Shape(optional=_all_text("username feedbackPercentage sellerAccountType", feedbackScore=NUMBER)),
        marketingPrice=Shape(optional=_all_text("discountPercentage priceTreatment", originalPrice=_AMOUNT, discountAmount=_AMOUNT)),
        currentBidPrice=_AMOUNT,
        unitPrice=_AMOUNT,
        bidCount=NUMBER,
        watchCount=NUMBER,
        adultOnly=FLAG,
        availableCoupons=FLAG,
        topRatedBuyingExperience=FLAG,
        priorityListing=FLAG,
    ),
    first={
        "shippingOptions": Shape(optional=_all_text("shippingCostType type shippingCarrierCode minEstimatedDeliveryDate maxEstimatedDeliveryDate", shippingCost=_AMOUNT, guaranteedDelivery=FLAG)),
        "categories": Shape(optional=_all_text("categoryId categoryName")),
    },
    texts=("buyingOptions", "leafCategoryIds", "qualifiedPrograms"),
    each={"thumbnailImages": "imageUrl", "additionalImages": "imageUrl"},
)
#: Fields of a product of a catalog page; its retail price is read apart, as it may be a number or a text.
CATALOG_PRODUCT = Shape(required=("productId", "title"), optional=_all_text("urlKey styleId productType brand", productAttributes=Shape(optional=_all_text("colorway gender releaseDate season"))))

# Condition codes of the search pages, in natural order.
CONDITION_CODES = {
    "1000": "new", "1500": "new", "1750": "new",
    "2000": "refurbished", "2010": "refurbished", "2020": "refurbished", "2030": "refurbished", "2500": "refurbished",
    "3000": "used", "4000": "used", "5000": "used", "6000": "used", "7000": "used",
}


def map_condition(code: Column, text: Column) -> Column:
    """By code, else by words in the text, else unknown."""
    low = F.lower(text)
    by_text = F.when(low.contains("refurb"), "refurbished").when(low.contains("new"), "new").when(low.rlike("used|parts|good|acceptable"), "used")
    return F.coalesce(look_up(CONDITION_CODES, code), by_text, F.lit("unknown"))


def price_of(amount: Column) -> Column:
    """The number in an amount; null without one, an error if it is none or negative."""
    number = amount["value"].try_cast("double")
    wrong = amount["value"].isNotNull() & (number.isNull() | (number < 0))
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a price: "), amount["value"]))).otherwise(number)


def place_of(where: Column) -> Column:
    """City, else state, else postal code, and the country."""
    full = lambda n: F.nullif(where[n], F.lit(""))
    return F.nullif(F.concat_ws(", ", F.coalesce(full("city"), full("stateOrProvince"), full("postalCode")), full("country")), F.lit(""))


def filled_map(entries: dict[str, Column]) -> Column:
    """A map of the entries that are neither null nor empty."""
    full = F.map_from_arrays(F.array(*(F.lit(k) for k in entries)), F.array(*(v.cast("string") for v in entries.values())))
    return F.map_filter(full, lambda k, v: v.isNotNull() & (v != ""))


def _listed(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), ",")


def _extra(s: Column) -> Column:
    text = {
        "condition_id": "conditionId", "condition_text": "condition", "item_creation_date": "itemCreationDate", "item_end_date": "itemEndDate",
        "unit_pricing_measure": "unitPricingMeasure", "epid": "epid", "legacy_item_id": "legacyItemId", "item_href": "itemHref",
        "item_affiliate_web_url": "itemAffiliateWebUrl", "item_group_type": "itemGroupType", "subtitle": "subtitle",
        "short_description": "shortDescription", "listing_marketplace_id": "listingMarketplaceId",
    }
    nested = {
        "image_url": "image.imageUrl", "seller": "seller.username", "seller_feedback_percentage": "seller.feedbackPercentage",
        "seller_account_type": "seller.sellerAccountType", "item_city": "itemLocation.city", "item_state": "itemLocation.stateOrProvince",
        "item_postal_code": "itemLocation.postalCode", "item_country": "itemLocation.country",
        "discount_percentage": "marketingPrice.discountPercentage", "price_treatment": "marketingPrice.priceTreatment",
        "original_price": "marketingPrice.originalPrice.value", "original_price_currency": "marketingPrice.originalPrice.currency",
        "discount_amount": "marketingPrice.discountAmount.value", "discount_amount_currency": "marketingPrice.discountAmount.currency",
        "current_bid_price": "currentBidPrice.value", "current_bid_currency": "currentBidPrice.currency",
        "unit_price": "unitPrice.value", "unit_price_currency": "unitPrice.currency",
    }

    def at(path: str, base: Column = s) -> Column:
        for name in path.split("."):
            base = base[name]
        return base

    ship, category = s["shippingOptions"], s["categories"]
    entries = {k: s[v] for k, v in text.items()} | {k: at(v) for k, v in nested.items()}
    entries |= {k: _listed(s[v]) for k, v in {"buying_options": "buyingOptions", "leaf_category_ids": "leafCategoryIds", "qualified_programs": "qualifiedPrograms"}.items()}
    entries |= {k: _listed(s[v]) for k, v in {"thumbnail_image_urls": "thumbnailImages", "additional_image_urls": "additionalImages"}.items()}
    entries |= {k: plain_number(at(v)) for k, v in {"seller_feedback_score": "seller.feedbackScore", "bid_count": "bidCount", "watch_count": "watchCount"}.items()}
    entries |= {k: s[v] for k, v in {"adult_only": "adultOnly", "available_coupons": "availableCoupons", "top_rated_buying_experience": "topRatedBuyingExperience", "priority_listing": "priorityListing"}.items()}
    entries |= {
        "shipping_cost": ship["shippingCost"]["value"], "shipping_currency": ship["shippingCost"]["currency"], "shipping_cost_type": ship["shippingCostType"],
        "shipping_type": ship["type"], "shipping_carrier": ship["shippingCarrierCode"], "shipping_min_delivery": ship["minEstimatedDeliveryDate"],
        "shipping_max_delivery": ship["maxEstimatedDeliveryDate"], "shipping_guaranteed_delivery": ship["guaranteedDelivery"],
        "category_id": category["categoryId"], "category_name": category["categoryName"],
    }
    return filled_map(entries)


def _listing(**columns: Column) -> list[Column]:
    nothing = {"posted_at": F.lit(None).cast("timestamp"), "scanned_at": F.current_timestamp()}
    return [v.alias(k) for k, v in (columns | nothing).items()]


def search_listings(pages: DataFrame, *, provider: str = "ebay_browse", default_currency: str = "EUR") -> DataFrame:
    """Listings of search pages (a JSON document in each row's ``text``).

    A page without summaries has none; one that is malformed, or in which a field has another type than it should, is an error that names the field.
    """
    s = F.col("s")
    items = checked(pages, "itemSummaries", SEARCH_ITEM, "s")
    return items.select(
        *_listing(
            listing_id=s["itemId"],
            title=s["title"],
            provider=F.lit(provider),
            url=s["itemWebUrl"],
            price=price_of(s["price"]),
            currency=F.coalesce(F.nullif(s["price"]["currency"], F.lit("")), F.lit(default_currency)),
            location=place_of(s["itemLocation"]),
            condition=map_condition(s["conditionId"], s["condition"]),
            extra=_extra(s),
        )
    )


def market_summary(market: DataFrame) -> DataFrame:
    """(product_id, lowest_ask, highest_bid, variant_count) of market data; ``market`` has product_id and the JSON ``text``."""
    rows = market.select("product_id", F.explode(F.from_json("text", MARKET_DATA)).alias("v"))
    amount = lambda n: F.col(f"v.{n}").try_cast("double")
    return rows.groupBy("product_id").agg(F.min(amount("lowestAskAmount")).alias("lowest_ask"), F.max(amount("highestBidAmount")).alias("highest_bid"), F.count("*").alias("variant_count"))


def catalog_products(pages: DataFrame) -> DataFrame:
    """``page, place, product_id`` of the products of catalog pages that have an id; what else is wrong with them ``catalog_listings`` tells."""
    rows = entries(pages, "products").where(kind_of(at(F.col("entry"), "productId")) == TEXT)
    return rows.select("page", "place", at(F.col("entry"), "productId", "string").alias("product_id"))


def catalog_listings(pages: DataFrame, market: DataFrame, *, provider: str = "stockx", currency: str = "USD") -> DataFrame:
    """Listings of catalog pages, left-joined with their market data: a product without any stays, without a price."""
    p, entry = F.col("p"), F.col("entry")
    rows = entries(pages, "products")
    first = F.coalesce("problem", F.get(problems(entry, CATALOG_PRODUCT, "products[]"), F.lit(0)))
    sound = rows.where(F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(True))
    retail = at(entry, "productAttributes.retailPrice")
    amount = F.when(kind_of(retail).isin(NUMBER, TEXT), F.variant_get(retail, "$", "string").try_cast("double"))
    products = sound.select(read(entry, CATALOG_PRODUCT).alias("p"), amount.alias("retail_price")).withColumn("product_id", p["productId"])
    known = products.join(market_summary(market), "product_id", "left")
    a = p["productAttributes"]
    extra = {
        "style_id": p["styleId"], "product_type": p["productType"], "brand": p["brand"], "colorway": a["colorway"], "gender": a["gender"],
        "release_date": a["releaseDate"], "season": a["season"], "retail_price": plain_number(F.col("retail_price")),
        "variant_count": F.col("variant_count"), "lowest_ask": plain_number(F.col("lowest_ask")), "highest_bid": plain_number(F.col("highest_bid")),
    }
    return known.select(
        *_listing(
            listing_id=F.col("product_id"),
            title=p["title"],
            provider=F.lit(provider),
            url=F.concat(F.lit("https://stockx.com/"), F.coalesce(F.nullif(p["urlKey"], F.lit("")), F.col("product_id"))),
            price=F.col("lowest_ask"),
            currency=F.lit(currency),
            location=F.lit(None).cast("string"),
            condition=F.lit("new"),
            extra=filled_map(extra),
        )
    )
