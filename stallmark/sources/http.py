"""HTTP for connectors: typed errors, retries, a rate limit, tokens. Everything that waits or sends can be injected.

A quota is for a whole account: one reader takes it from a ``TokenBucket``, tasks side by side
deal it among themselves (see ``requests``). Pages go to Spark as JSON texts.
"""

from __future__ import annotations

import base64
import json
import os
import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

# Statuses after which a request is sent again.
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})


class SourceError(Exception):
    """A connector failed; ``source`` names it."""

    def __init__(self, message: str, *, source: str | None = None):
        super().__init__(f"{source}: {message}" if source else message)
        self.source = source


class SourceConfigError(SourceError, ValueError):
    """Settings that cannot be used."""


class SourceAuthError(SourceError):
    """No token."""


class ResponseError(SourceError):
    """An answer that is not what was asked for."""


class RequestError(SourceError):
    """A request without an answer; ``attempts`` counts how often it was sent."""

    attempts = 1


class TimedOut(RequestError):
    pass


class Unreachable(RequestError):
    pass


class BadStatus(RequestError):
    def __init__(self, status: int, *, retry_after: float | None = None, source: str | None = None):
        super().__init__(f"HTTP {status}", source=source)
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class Request:
    url: str
    params: Mapping[str, str] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)
    method: str = "GET"
    body: bytes | None = None
    timeout: float = 10.0

    @property
    def full_url(self) -> str:
        if not self.params:
            return self.url
        return f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode(self.params)}"


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes
    headers: Mapping[str, str] = field(default_factory=dict)

    def json(self) -> object:
        try:
            return json.loads(self.body)
        except ValueError as e:
            raise ResponseError("not JSON") from e


Transport = Callable[[Request], Response]


def send_with_urllib(request: Request) -> Response:
    """The real transport; failures become the typed errors above."""
    out = urllib.request.Request(request.full_url, data=request.body, method=request.method, headers=dict(request.headers))
    try:
        with urllib.request.urlopen(out, timeout=request.timeout) as answer:
            return Response(answer.status, answer.read(), {k.lower(): v for k, v in answer.headers.items()})
    except urllib.error.HTTPError as e:
        wait = e.headers.get("Retry-After") if e.headers else None
        raise BadStatus(e.code, retry_after=_number(wait)) from e
    except TimeoutError as e:
        raise TimedOut("timed out") from e
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimedOut("timed out") from e
        raise Unreachable(f"no connection: {e.reason}") from e


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def check_url(url: str, name: str) -> str:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise SourceConfigError(f"{name} must be an http(s) URL, got {url!r}")
    return url


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 3
    backoff_base: float = 0.5
    backoff_factor: float = 2.0
    max_backoff: float = 30.0
    jitter: bool = True
    retry_on_status: frozenset[int] = RETRY_STATUS

    def __post_init__(self) -> None:
        for ok, message in (
            (self.max_attempts >= 1, "max_attempts must be >= 1"),
            (self.backoff_base >= 0, "backoff_base must be >= 0"),
            (self.backoff_factor >= 1, "backoff_factor must be >= 1"),
            (self.max_backoff >= 0, "max_backoff must be >= 0"),
        ):
            if not ok:
                raise SourceConfigError(message)

    def again(self, error: SourceError) -> bool:
        return error.status in self.retry_on_status if isinstance(error, BadStatus) else isinstance(error, (TimedOut, Unreachable))

    def delay(self, attempt: int, rng: Callable[[], float] = random.random) -> float:
        """Seconds to wait after the given attempt, at least half of the full delay."""
        full = min(self.max_backoff, self.backoff_base * self.backoff_factor ** (attempt - 1))
        return full * (0.5 + 0.5 * rng()) if self.jitter else full

    def run(self, operation: Callable[[], Response], *, sleep: Callable[[float], None] = time.sleep, rng: Callable[[], float] = random.random) -> Response:
        for attempt in range(1, self.max_attempts + 1):
            try:
                return operation()
            except RequestError as e:
                e.attempts = attempt
                if attempt == self.max_attempts or not self.again(e):
                    raise
                sleep(max(self.delay(attempt, rng), getattr(e, "retry_after", None) or 0.0))
        raise AssertionError("unreachable")


class TokenBucket:
    """At most ``rate`` requests a second, and ``capacity`` at once."""

    def __init__(self, rate: float, capacity: int = 1, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or capacity < 1:
            raise ValueError("rate must be positive and capacity at least 1")
        self.rate, self.capacity, self._clock, self._sleep = rate, capacity, clock, sleep
        self._level, self._at, self._lock = float(capacity), clock(), threading.Lock()

    def try_acquire(self) -> float:
        """0 if a token was taken, else the seconds until there is one."""
        with self._lock:
            now = self._clock()
            self._level = min(self.capacity, self._level + max(0.0, now - self._at) * self.rate)
            self._at = now
            if self._level >= 1:
                self._level -= 1
                return 0.0
            return (1 - self._level) / self.rate

    def acquire(self) -> None:
        while (wait := self.try_acquire()) > 0:
            self._sleep(wait)


Authorization = Callable[[], str | None]


def bearer(token: str, scheme: str = "Bearer") -> Authorization:
    if not token:
        raise SourceConfigError("token must not be empty")
    return lambda: f"{scheme} {token}" if scheme else token


def _minted(answer: Response) -> dict:
    if not 200 <= answer.status < 300:
        raise SourceAuthError(f"token endpoint returned HTTP {answer.status}")
    try:
        data = answer.json()
    except ResponseError as e:
        raise SourceAuthError("token endpoint returned no JSON") from e
    if not isinstance(data, dict) or not isinstance(data.get("access_token"), str) or not data["access_token"]:
        raise SourceAuthError("token endpoint returned no token")
    return data


class OAuthToken:
    """A token from a token endpoint, kept until ``leeway`` seconds before it ends; errors never show credentials."""

    def __init__(self, token_url: str, form: Mapping[str, str], *, basic: tuple[str, str] | None = None, transport: Transport = send_with_urllib, leeway: float = 60.0, clock: Callable[[], float] = time.monotonic, on_token: Callable[[dict], None] | None = None, timeout: float = 10.0):
        self._url, self._form, self._basic = check_url(token_url, "token_url"), dict(form), basic
        self._transport, self._leeway, self._clock, self._on_token, self._timeout = transport, leeway, clock, on_token, timeout
        self._token, self._ends, self._lock = "", 0.0, threading.Lock()

    def __call__(self) -> str:
        with self._lock:
            if not self._token or self._clock() >= self._ends - self._leeway:
                headers = {"Content-Type": "application/x-www-form-urlencoded", "Accept": "application/json"}
                if self._basic:
                    headers["Authorization"] = "Basic " + base64.b64encode(":".join(self._basic).encode()).decode()
                try:
                    answer = self._transport(Request(self._url, headers=headers, method="POST", body=urllib.parse.urlencode(self._form).encode(), timeout=self._timeout))
                except SourceError as e:
                    raise SourceAuthError(f"failed to obtain a token: {type(e).__name__}") from None
                data = _minted(answer)
                if "refresh_token" in self._form and isinstance(data.get("refresh_token"), str):
                    self._form["refresh_token"] = data["refresh_token"]
                life = data.get("expires_in")
                self._token = data["access_token"]
                self._ends = self._clock() + (float(life) if isinstance(life, (int, float)) and not isinstance(life, bool) else 0.0)
                if self._on_token:
                    self._on_token(data)
            return f"Bearer {self._token}"


def client_credentials(token_url: str, client_id: str, client_secret: str, scope: str | None = None, **options) -> OAuthToken:
    if not client_id or not client_secret:
        raise SourceConfigError("client_id and client_secret must not be empty")
    form = {"grant_type": "client_credentials"} | ({"scope": scope} if scope else {})
    return OAuthToken(token_url, form, basic=(client_id, client_secret), **options)


def refresh_token(token_url: str, client_id: str, client_secret: str, token: str, scope: str | None = None, **options) -> OAuthToken:
    """A token by a refresh token that an interactive login has left elsewhere."""
    if not token:
        raise SourceConfigError("refresh token must not be empty")
    form = {"grant_type": "refresh_token", "client_id": client_id, "client_secret": client_secret, "refresh_token": token} | ({"scope": scope} if scope else {})
    return OAuthToken(token_url, form, **options)


class TokenFile:
    """A JSON file of tokens for its owner alone; saving merges, and replaces the file in one step."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> dict[str, object]:
        try:
            data = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}
        return data if isinstance(data, dict) else {}

    def save(self, values: Mapping[str, object]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump(self.load() | dict(values), f)
        os.replace(part, self.path)


class Client:
    """Sends requests: default headers, authorization, rate limit, retries."""

    def __init__(self, *, headers: Mapping[str, str] | None = None, auth: Authorization | None = None, transport: Transport = send_with_urllib, retry: RetryPolicy | None = None, limiter: TokenBucket | None = None, sleep: Callable[[float], None] = time.sleep, rng: Callable[[], float] = random.random, timeout: float = 10.0):
        self.headers, self.auth, self.transport, self.retry = dict(headers or {}), auth, transport, retry or RetryPolicy()
        self.limiter, self.sleep, self.rng, self.timeout = limiter, sleep, rng, timeout

    def all_headers(self, headers: Mapping[str, str] | None = None) -> dict[str, str]:
        """What a request is sent with, the authorization of this moment included."""
        own = self.headers | dict(headers or {})
        if self.auth and (value := self.auth()):
            own["Authorization"] = value
        return own

    def get(self, url: str, params: Mapping[str, str] | None = None, headers: Mapping[str, str] | None = None) -> Response:
        def once() -> Response:
            if self.limiter:
                self.limiter.acquire()
            answer = self.transport(Request(url, params or {}, self.all_headers(headers), timeout=self.timeout))
            if not 200 <= answer.status < 300:
                raise BadStatus(answer.status, retry_after=_number(answer.headers.get("retry-after")))
            return answer

        return self.retry.run(once, sleep=self.sleep, rng=self.rng)
