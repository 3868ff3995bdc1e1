"""Sending alerts and events to the platforms that take them; from the driver only, a document at a time."""

from __future__ import annotations

import http.client
import json
import os
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit


class PushError(RuntimeError):
    """The receiver refused or can't be reached."""


class Receiver:
    """One connection to a platform; `prefix` is what its key follows in the header."""

    def __init__(self, base: str, path: str, variable: str, prefix: str = "", key: str | None = None, timeout: float = 30):
        secret = key or os.environ.get(variable)
        if not secret:
            raise PushError(f"set {variable} in the environment")
        at = urlsplit(base)
        if at.scheme not in ("http", "https") or not at.hostname:
            raise PushError(f"{base!r} is no address")
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        self.connection = kind(at.hostname, at.port, timeout=timeout)
        self.path = at.path.rstrip("/") + path
        self.headers = {"Authorization": prefix + secret, "Content-Type": "application/json", "Accept": "application/json"}

    def send(self, body: str) -> tuple[int, str]:
        """(status, answer); PushError if no answer comes."""
        try:
            self.connection.request("POST", self.path, body.encode("utf-8"), self.headers)
            answer = self.connection.getresponse()
            return answer.status, answer.read().decode("utf-8", "replace")
        except (OSError, http.client.HTTPException) as e:
            raise PushError(f"{self.connection.host}: {e}") from e
        finally:
            self.connection.close()


def _answer(status: int, text: str) -> dict:
    if status >= 300:
        raise PushError(f"HTTP {status}: {text[:300]}")
    try:
        found = json.loads(text or "{}")
    except ValueError as e:
        raise PushError(f"no JSON: {text[:300]}") from e
    return found if isinstance(found, dict) else {}


def thehive(base: str, bodies: Iterable[str], key: str | None = None) -> Iterator[str]:
    """A line an alert; that it is there already is no error."""
    receiver = Receiver(base, "/api/v1/alert", "THEHIVE_API_KEY", "Bearer ", key)
    for body in bodies:
        status, text = receiver.send(body)
        if status == 400 and "exist" in text.lower():
            yield f"exists {json.loads(body)['sourceRef']}"
        else:
            yield f"created {_answer(status, text).get('_id', '?')}"


def misp(base: str, bodies: Iterable[str], key: str | None = None) -> Iterator[str]:
    receiver = Receiver(base, "/events", "MISP_API_KEY", "", key)
    for body in bodies:
        yield f"created {_answer(*receiver.send(body)).get('Event', {}).get('id', '?')}"
