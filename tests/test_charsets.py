"""Pages in many charsets come back equal, declared or not, and the edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.functions import charsets

#: The same passage in many languages, and the charsets it is written in.
SAID = {
    "ru": ("Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.", ["windows-1251", "koi8-r", "ibm866"]),
    "el": ("Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση.", ["windows-1253"]),
    "pl": ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.", ["windows-1250"]),
    "cs": ("Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.", ["windows-1250"]),
    "fr": ("Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.", ["windows-1252"]),
    "es": ("Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, ¿deben comportarse fraternalmente los unos con los otros mañana?", ["windows-1252"]),
    "tr": ("Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.", ["windows-1254"]),
    "ja": ("すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。", ["shift_jis", "euc-jp"]),
    "zh": ("人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。", ["gb18030"]),
    "zh-tw": ("人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。", ["big5"]),
    "ko": ("모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.", ["euc-kr"]),
    "he": ("כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.", ["windows-1255"]),
    "th": ("มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม", ["windows-874"]),
}
CASES = [(lang, label) for lang, (_, labels) in SAID.items() for label in labels]


@pytest.mark.parametrize("lang,label", CASES)
def test_pages_come_back_equal(lang, label):
    """Undeclared, declared by the server, by the page, and by the page against the server, which wins."""
    codec, said = charsets.codec_of(label), SAID[lang][0]
    plain = f"<html><head><title>{said[:20]}</title></head><body><p>{said}</p><p>plain text</p></body></html>"
    assert charsets.decode(plain.encode(codec)) == (label, plain)
    assert charsets.decode(plain.encode(codec), f"text/html; charset={label.upper()}") == (label, plain)
    for form in ('<meta charset="{}">', "<meta charset={}>", '<meta http-equiv="Content-Type" content="text/html; charset={}">', "<!-- <meta charset=utf-8> --><meta charset='{}'>"):
        page = form.format(label) + plain
        assert charsets.decode(page.encode(codec)) == (label, page)
    page = '<meta charset="utf-8">' + plain
    assert charsets.decode(page.encode(codec), f"text/html;charset={label}") == (label, page)


@pytest.mark.parametrize("lang", SAID)
def test_utf_8_is_told_from_all(lang):
    said = SAID[lang][0]
    assert charsets.decode(said.encode()) == ("utf-8", said)
    for codec, label in (("utf-8-sig", "utf-8"), ("utf-16", "utf-16le")):
        assert charsets.decode(said.encode(codec), "text/html; charset=koi8-r") == (label, said)


def test_edges(spark):
    rows = [(None, None), (b"", None), (b"abc", "text/html; charset=nosuch"), ("é".encode("cp1252"), None), (b"a\xffb", "text/html; charset=utf-8"), (b"\xff\xfea\x00\x00\xd8b\x00", None), (b'<meta charset="utf-16">x', None), (b"a" * 2000 + b"<meta charset=koi8-r>", None), (("Straße " * 50_000).encode("cp1252"), "")]
    frame = spark.createDataFrame(rows, "body binary, kind string")
    found = [tuple(r) for r in frame.select(charsets.decoded("body", "kind").alias("d")).select("d.*").collect()]
    assert found[:5] == [(None, None), ("utf-8", ""), ("utf-8", "abc"), ("windows-1252", "é"), ("utf-8", "ab")]
    assert found[5][0] == "utf-16le" and found[5][1].startswith("a") and found[6][0] == "utf-8" and found[7][0] == "utf-8"
    assert found[8] == ("windows-1252", "Straße " * 50_000)
    assert frame.limit(0).select(charsets.decoded("body", F.lit(None).cast("string"))).count() == 0
    for label in ("base64", "rot13", "hex", "undefined-x"):  # codecs that aren't charsets
        assert charsets.codec_of(label) is None


def test_the_language_a_page_names_settles_close_cases():
    """A page of one repeated word is as plausible in Greek letters; one that is plainly in another script stays what it is."""
    page = '<!DOCTYPE html><html class="x" lang="fr"><body><p>' + "é è éé " * 40 + "</p></body></html>"
    assert charsets.decode(page.encode("cp1252")) == ("windows-1252", page)
    for lang, label in CASES:
        said = f'<html lang="en"><body><p>{SAID[lang][0]}</p></body></html>'
        assert charsets.decode(said.encode(charsets.codec_of(label))) == (label, said)
