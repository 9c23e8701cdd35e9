"""Text of pages in any charset: what a byte order mark, the server or the page declares, else what the bytes look like.

The order is the one that browsers follow: a byte order mark, the charset of the Content-Type header, the first declaration in the
head of the page, then the bytes themselves. Bytes that are UTF-8 are UTF-8. Of the legacy code pages, those for two-byte scripts must decode
without a fault and are scored by how many of their pairs lie where the frequent characters of the script are; the others by how plausible the letters are
that they make: frequent letters of their script count most, capitals inside a word and signs between letters count against them. The language
that the page itself names speaks for the code pages it is written in, but not against bytes that plainly say otherwise.

Edge cases: a null body has no charset and no text; an empty one is UTF-8. Declarations that no one knows are passed over; a page that
declares UTF-16 in its own markup can't be in it and is UTF-8. Bytes that a charset doesn't have are dropped in UTF-8 and become U+FFFD in others. Bodies of any length are
looked at whole.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels that the web uses and the codecs that browsers take for them; other names are looked up among Python's codecs.
LABELS = {
    "utf-8": "utf-8", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be",
    "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "l1": "cp1252", "windows-1252": "cp1252", "cp1252": "cp1252", "x-cp1252": "cp1252",
    "windows-1250": "cp1250", "windows-1251": "cp1251", "windows-1253": "cp1253", "windows-1254": "cp1254", "iso-8859-9": "cp1254", "latin5": "cp1254", "windows-1255": "cp1255",
    "windows-1256": "cp1256", "windows-1257": "cp1257", "windows-1258": "cp1258", "windows-874": "cp874", "tis-620": "cp874", "iso-8859-11": "cp874", "koi8-r": "koi8-r", "koi8": "koi8-r", "koi8-u": "koi8-u",
    "ibm866": "cp866", "cp866": "cp866", "macintosh": "mac-roman", "x-mac-roman": "mac-roman", "x-mac-cyrillic": "mac-cyrillic",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "euc-jp": "euc_jp", "x-euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp",
    "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "x-gbk": "gb18030", "big5": "big5hkscs", "big5-hkscs": "big5hkscs", "x-x-big5": "big5hkscs",
    "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "korean": "cp949", "windows-949": "cp949",
}
#: The name that results give to a codec.
NAMES = {"cp1252": "windows-1252", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be", "cp932": "shift_jis", "euc_jp": "euc-jp", "big5hkscs": "big5", "cp949": "euc-kr", "mac-roman": "macintosh", "cp866": "ibm866"} | {f"cp125{k}": f"windows-125{k}" for k in (0, 1, 3, 4, 5, 6, 7, 8)} | {"cp874": "windows-874"}
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Bytes of a page in which a declaration counts.
HEAD = 1024
COMMENT, META = re.compile(rb"<!--.*?(?:-->|\Z)", re.DOTALL), re.compile(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
XML = re.compile(rb"^\s*<\?xml\s[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9_:.-]+)", re.IGNORECASE)
HEADER = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)

#: Two-byte charsets: spans of first bytes, the least second byte, and what a pair in them says; other pairs say the last number.
PAIRS = {
    "cp932": (((0x82, 0x82, 0x9F, 1.3), (0x83, 0x83, 0x40, 1.0), (0x88, 0x97, 0x40, 0.8), (0x81, 0x81, 0x40, 0.3), (0x98, 0x9F, 0x40, 0.1), (0xE0, 0xEA, 0x40, 0.1)), -0.5),
    "euc_jp": (((0xA4, 0xA5, 0xA1, 1.3), (0xB0, 0xCF, 0xA1, 0.8), (0xA1, 0xA3, 0xA1, 0.3)), -0.5),
    "cp949": (((0xB0, 0xC8, 0xA1, 1.1), (0xA1, 0xA3, 0xA1, 0.3)), -1.0),
    "gb18030": (((0xB0, 0xD7, 0xA1, 1.0), (0xA1, 0xA3, 0xA1, 0.3), (0xD8, 0xF7, 0xA1, 0.2)), -0.5),
    "big5hkscs": (((0xA4, 0xC6, 0x40, 1.0), (0xA1, 0xA3, 0x40, 0.3), (0xC9, 0xF9, 0x40, 0.2)), -1.0),
}
#: One-byte charsets, in the order that settles ties: frequent letters, and a pattern for all letters of the script.
LETTERS = {
    "cp1252": ("éèàùâêîôûçëïüöäßñáíóúåæøãõÉÈÀÇÊÔÜÖÄÑÁÍÓÚÅÆØ¿¡", "[À-ÖØ-öø-ÿŒœŠšŽž]"),
    "cp1250": ("ąćęłńóśźżáčďéěíňřšťúůýžőűöüăâîşţÁČĎÉĚÍŇŘŠŤÚŮÝŽŁŚŻŐŰÖÜĄĆĘŃŹ", "[À-ſ]"),
    "cp1254": ("ığşöçüâîİĞŞÖÇÜ", "[À-ſ]"),
    "cp1251": ("оеаинтсрвлкмдпу", "[А-яЁёЂ-Џђ-џҐґ]"),
    "koi8-r": ("оеаинтсрвлкмдпу", "[А-яЁё]"),
    "cp866": ("оеаинтсрвлкмдпу", "[А-яЁё]"),
    "cp1253": ("αοιετσνηυρπκμλςάέήίόύώ", "[Ά-ώ]"),
    "cp1255": ("יוהאלרתבשמםןנ", "[א-ת]"),
    "cp1256": ("اليمنرتبةعدسفهكوأ", "[ء-يپچژگ]"),
    "cp874": ("านรกอเงมยลวดทสตะปบคหแจพชขใไโ่้ีัิื", "[ก-๛]"),
}
#: Code pages by language, as browsers fall back to them, and how much a page's own `lang` adds to their score. English says nothing, as templates leave it in.
WRITTEN = {
    lang: codecs_
    for langs, codecs_ in (
        ("fr de es pt it nl sv da no nb nn fi is ca gl eu ga af", ("cp1252",)), ("pl cs sk hu sl hr ro bs", ("cp1250",)), ("tr", ("cp1254",)), ("ru uk be bg mk sr", ("cp1251", "koi8-r", "cp866")),
        ("el", ("cp1253",)), ("he yi", ("cp1255",)), ("ar fa ur", ("cp1256",)), ("th", ("cp874",)), ("ja", ("cp932", "euc_jp")), ("ko", ("cp949",)), ("zh", ("gb18030", "big5hkscs")),
    )
    for lang in langs.split()
}
NAMED = 0.25
LANG = re.compile(rb"<html\s(?:[^>]*?\s)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)
WORD = re.compile(rb"[A-Za-z\x80-\xff]*[\x80-\xff][A-Za-z\x80-\xff]*")
PAIR = re.compile(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]")


def codec_of(label: str) -> str | None:
    """The codec of a declared label; none if no one knows it."""
    label = label.strip().lower()
    if label in LABELS:
        return LABELS[label]
    try:
        found = codecs.lookup(label)
    except (LookupError, ValueError):
        return None
    return found.name if getattr(found, "_is_text_encoding", True) else None


def declared(body: bytes, content_type: str | None) -> str | None:
    """The codec that a mark, the header or the page declares."""
    for mark, codec in MARKS:
        if body.startswith(mark):
            return codec
    if content_type and (m := HEADER.search(content_type)) and (codec := codec_of(m[1])):
        return codec
    head = body[:HEAD]
    for found in (*XML.findall(head), *META.findall(COMMENT.sub(b" ", head))):
        if codec := codec_of(found.decode("ascii")):
            return "utf-8" if codec.startswith("utf-16") else codec
    return None


def pair_score(body: bytes, codec: str) -> float:
    """How far the pairs of a body lie among the frequent characters of a two-byte charset; it must decode."""
    try:
        codecs.getincrementaldecoder(codec)("strict").decode(body)  # a body may end inside a character
    except UnicodeDecodeError:
        return -9.0
    spans, other = PAIRS[codec]
    pairs = Counter(PAIR.findall(body))
    total = sum(n * next((w for low, high, second, w in spans if low <= a <= high and b >= second), other) for (a, b), n in pairs.items())
    return total / pairs.total() if pairs else -9.0


def letter_score(words: Counter[bytes], codec: str) -> float:
    """How plausible the letters are that a one-byte charset makes of the words with bytes beyond ASCII."""
    frequent, script = LETTERS[codec]
    letter = re.compile(script)
    other_alphabet, total, n = script[1] > "\u036f", 0.0, 0
    for word, times in words.items():
        before = ""
        for c in word.decode(codec, "replace"):
            if c > "\x7f":
                n += times
                if not letter.match(c) and c not in frequent:
                    says = -1.0
                elif c.isupper() and before.islower():
                    says = -1.0
                elif c in frequent:
                    says = 1.0
                else:
                    says = 0.5 if c.islower() or other_alphabet and not c.isupper() else 0.3
                # Letters of two alphabets don't mix in a word; in a Latin one, letters beyond ASCII seldom follow each other.
                mixes = before.isascii() and before.isalpha() if other_alphabet else before > "\x7f"
                total += times * (says - 0.5 * mixes)
            before = c
    return total / n if n else -9.0


def is_utf8(body: bytes) -> bool:
    """Whether all bytes are UTF-8; a body may end inside a character if it has others beyond ASCII."""
    try:
        body.decode("utf-8")
    except UnicodeDecodeError as fault:
        return fault.reason == "unexpected end of data" and not body[: fault.start].isascii()
    return True


def looks_like(body: bytes) -> str:
    """The codec that the bytes suggest."""
    if is_utf8(body):
        return "utf-8"
    words = Counter(WORD.findall(body))
    scores = {c: letter_score(words, c) for c in LETTERS} | {c: pair_score(body, c) for c in PAIRS}
    if max(scores.values()) > -9 and (named := LANG.search(COMMENT.sub(b" ", body[:HEAD]))):
        for codec in WRITTEN.get(named[1].decode().lower(), ()):
            scores[codec] += NAMED
    best = max(scores.values())
    return next(c for c in (*PAIRS, *LETTERS) if scores[c] == best) if best > -9 else "cp1252"


def charset_of(body: bytes, content_type: str | None = None) -> str:
    return declared(body, content_type) or looks_like(body)


def decode(body: bytes | None, content_type: str | None = None) -> tuple[str | None, str | None]:
    """The name of a body's charset, and its text."""
    if body is None:
        return None, None
    codec = charset_of(body, content_type)
    text = body.decode(codec, "ignore" if codec == "utf-8" else "replace").removeprefix("﻿")
    return NAMES.get(codec, codec), "".join(c if not "\ud800" <= c <= "\udfff" else "�" for c in text) if codec.startswith("utf-16") else text


@F.pandas_udf(T.StructType([T.StructField("charset", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """Charset and text of bodies (binary) with their Content-Type headers (may be null)."""
    rows = [decode(None if b is None else bytes(b), c) for b, c in zip(body, content_type, strict=True)]
    return pd.DataFrame(rows, columns=["charset", "text"])
