"""The few scalar functions that Python workers need beside the tree parser; the same results as the Column functions."""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import parse_qsl, quote_plus, urlsplit

from tessera.functions import constants as K

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_URL = re.compile(r"([^:/?#]+)://([^/?#]*)([^?#;]*(?:;[^?#/]*/[^?#;]*)*)(;[^?#/]*)?(?:\?([^#]*))?", re.DOTALL)


def clean_text(text: str | None) -> str:
    """Entities decoded, compatibility forms folded, control characters and runs of white space as one blank."""
    if not text:
        return ""
    return " ".join(_CONTROL.sub(" ", unicodedata.normalize("NFKC", html.unescape(text))).split())


def similarity(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() if a and b else 0.0


def normalize_url(url: str | None) -> str:
    if not url:
        return ""
    url = url.strip()
    m = _URL.match(url if url.startswith(("http://", "https://")) else "https://" + url)
    if not m:
        return url
    scheme, host, path, params, query = m.groups()
    kept = [(k, v) for k, v in parse_qsl(query or "") if not k.startswith("utm_") and k not in K.TRACKING]
    path = path if path == "/" else path.rstrip("/")
    tail = "?" + "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept) if kept else ""
    return f"{scheme.lower()}://{host.lower()}{path}{params if params and params != ';' else ''}{tail}"


def domain(url: str | None) -> str:
    if not url:
        return ""
    try:
        host = urlsplit(url if "://" in url else "https://" + url).netloc
    except ValueError:
        return ""
    host = host.rpartition("@")[2].split(":")[0].lower()
    labels = host.split(".")
    two = ".".join(labels[-2:])
    if len(labels) >= 3 and two in K.SUFFIXES_2:
        return ".".join(labels[-3:])
    if len(labels) >= 2 and two not in K.SUFFIXES_2 and labels[-1] in K.SUFFIXES_1:
        return two
    return host.removeprefix("www.")


def is_http_url(url: str | None) -> bool:
    return bool(url and re.match("(?i)https?://[^/?#]+", url))
