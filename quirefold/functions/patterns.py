"""Regular expressions and character classes of the refinement operators.

Classes are spelled out so that every engine reads them alike: no engine-specific shorthand for white space or digits.
"""

from __future__ import annotations

#: white space as text processing in the source formats understands it (Unicode spaces and the separators 1C-1F)
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACES}]"
#: the same without the line feed, for rules that stay within a line
INLINE_WS = r"[\t\x0b-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: white space that separates no lines
BLANK = r"[\t\x1f\x20\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
DIGIT = r"\p{Nd}"
HAN = r"\x{4e00}-\x{9fff}"
#: Han, CJK punctuation and full-width forms
WIDE = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
#: line separators, the pair first
NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

#: stands for an apostrophe while quotes are paired (a private-use character)
MASK = "\ue000"
# fixed values: formats of the markers that recognisers and writers put into the text; (?d): only \\n ends a line
GROUNDING = rf"(?md)^{WS}*<\|ref\|>[^\n]*?<\|/ref\|>{WS}*<\|det\|>\[\[[^\n]*?\]\]<\|/det\|>{WS}*$"
PAGE_MARKER = rf"\n={{10,}}{WS}*\n{WS}*第{WS}*{DIGIT}+{WS}*页{WS}*\(共{WS}*{DIGIT}+{WS}*页\){WS}*\n{WS}*={{10,}}{WS}*\n*"
BATCH_MARKER = rf"(?md)^={{10,}}{WS}*\n{WS}*批次{WS}*{DIGIT}+{WS}*\(共{WS}*{DIGIT}+{WS}*批\){WS}*\n={{10,}}{WS}*$"
BATCH_SPLIT = rf"=+{WS}*批次{WS}*{DIGIT}+{WS}*\(共{WS}*{DIGIT}+{WS}*批\){WS}*=+"
PAGE_HEADER = rf"={{40,}}{WS}*\n第{WS}*({DIGIT}+){WS}*页{WS}*\(共{WS}*{DIGIT}+{WS}*页\){WS}*\n[={SPACES}]*\n+"

# fixed values: end marks, punctuation map, labels, watermark words
END_MARKS = "。！？；….!?;”’\"》])"
FULL_WIDTH = {",": "，", ".": "。", "!": "！", "?": "？", ":": "：", ";": "；", "(": "（", ")": "）", "[": "［", "]": "］", "{": "｛", "}": "｝", "<": "《", ">": "》"}
IGNORED_LABELS = ("number", "footer", "header", "header_image", "footer_image", "footnote", "aside_text", "image")
WATERMARKS = ("风眼", "风眠", "风眸", "风语", "风起", "风云", "风铃", "风语者")
FINGERPRINT = 30
SHORT_LINE = 10
#: digits outside the decimal category that count as digits before a full stop
OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
