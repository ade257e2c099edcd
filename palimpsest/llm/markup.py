"""Text of HTML fragments, in Python, for operators that must look at characters."""

from __future__ import annotations

import re
from html import unescape

#: Comments, scripts and style sheets with their content, and all other tags.
MARKUP = re.compile(r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>", re.S | re.I)


def without_markup(body: str, blank: str) -> str:
    """Tags and comments become `blank`; entities are decoded."""
    t = MARKUP.sub(blank, body) if "<" in body else body
    return unescape(t) if "&" in t else t
