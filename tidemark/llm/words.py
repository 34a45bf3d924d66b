"""Words of a text without case, punctuation, mark-up, escapes, breaks and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|code|sub|sup|font|mark|small|tt|kbd|wbr)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->", re.S)
UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
SPACE_ESCAPE = re.compile(r"\\[nrtfv]")
COLOUR = re.compile(r"\x1b?\[[0-9;]{1,12}m")
CELL = re.compile(r"(?m)^# %% \[[^\]\n]*\](?: In \[\d*\])?[ \t]*$")
HYPHEN = re.compile(r"(?<=[a-z])[-‐][ \t]*\r?\n[ \t>#|*/]*(?=[a-z])")
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]|[̀-ͯ]")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοανρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwABEKMHOPCTYXIJSoavpikABEZHIKMNOPTYX",
)


def plain(text: str) -> str:
    """The text in lower case, without mark-up, escapes, cell heads and invisible characters."""
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = UNICODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = SPACE_ESCAPE.sub(" ", text)
    if "[" in text:
        text = COLOUR.sub(" ", text)
    if "# %% [" in text:
        text = CELL.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).translate(LOOKALIKES)
    text = text.lower()
    if "-" in text or "‐" in text:
        text = HYPHEN.sub("", text)
    return text


def words(text: str) -> list[str]:
    """The words in order."""
    return WORD.findall(plain(text))
