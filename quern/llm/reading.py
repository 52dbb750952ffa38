"""Texts as a reader sees them: without markup, and as sentences or words."""

from __future__ import annotations

import html
import re
import unicodedata

#: Elements that part words where they stand; tags of all others vanish without a gap.
BLOCKS = "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|img|input|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul"
_BLOCK_TAG = re.compile(rf"</?(?:{BLOCKS})(?:\s[^<>]*)?/?>", re.I)
_OTHER_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.I | re.S)
_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_MARKDOWN_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_EMPHASIS_INSIDE = re.compile(r"(?<=\w)(?:\*{1,3}|~~|`)(?=\w)")
#: Letters nobody sees: soft hyphen, zero-width space, joiners, marks of direction, word joiner, byte order mark.
_UNSEEN = re.compile("[" + "\\u00ad\\u034f\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u206f\\ufe00-\\ufe0f\\ufeff" + "]")
_WORD = re.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")


def visible(text: str) -> str:
    """Text without tags, entities, link targets and unseen characters; code stays."""
    if "<" in text:
        text = _SCRIPT.sub(" ", text)
        text = _OTHER_TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _MARKDOWN_LINK.sub(r"\1", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    return text


def words(text: str | None) -> list[str]:
    """The words of a text, unbroken runs of letters and digits, in one spelling. None has none."""
    if not text:
        return []
    text = _EMPHASIS_INSIDE.sub("", visible(text))
    if text.isascii():
        return _PLAIN_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))
