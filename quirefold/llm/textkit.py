"""Text helpers shared by the operators of this package (plain Python, used inside Arrow batches)."""

from __future__ import annotations

import re

#: page and batch banners: a title line between two rules of ``=``
BANNER = re.compile(r"^[ \t]*={10,}[ \t]*\r?\n[^\n]{0,60}\n[ \t]*={10,}[ \t]*$", re.M)
#: grounding tags of layout-aware recognisers
GROUNDING = re.compile(r"<\|ref\|>.*?<\|/ref\|>\s*<\|det\|>.*?<\|/det\|>|<\|/?(?:ref|det|grounding)\|>", re.S)
#: a word broken at a line end by a hyphen-like mark
BROKEN = re.compile(r"[-‐¬­](?<=[^\W\d_].)[ \t]*\r?\n\s*(?=[^\W\d_])")
#: scripts written without spaces: kana, Han with extensions and compatibility forms, Hangul is spaced
CJK = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W\d_{CJK}]+|[{CJK}]|\d+")
#: the same for ASCII text in lower case
ASCII_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def tokens(text: str) -> list[str]:
    """Words, digit runs and single CJK characters; banners, tags, line breaks and hyphens at line ends don't count."""
    if "==========" in text:
        text = BANNER.sub(" ", text)
    if "<|" in text:
        text = GROUNDING.sub(" ", text)
    if "\n" in text:
        text = BROKEN.sub("", text)
    return ASCII_TOKEN.findall(text.lower()) if text.isascii() else TOKEN.findall(text.casefold())
