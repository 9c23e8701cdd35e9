"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English stop words.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should "
    "it its this that these those i we you he she they me us him her them not no nor so yet"
).split()

#: Phrases that count towards the spam score.
SPAM_PHRASES = ("buy now", "click here", "limited offer", "make money", "work from home", "free gift", "risk free", "no obligation", "act now", "cheap", "casino", "viagra", "cryptocurrency", "earn $", "guaranteed")

#: What parked pages say.
PARKED = r"(?i)(domain.*for sale|buy this domain|parked domain|coming soon|under construction)"

#: Parts of messages that tell a failed fetch's class, tried in this order.
ERROR_CLASSES = {
    "dns": ("no such host", "no addresses found", "server misbehaving", "name resolution"),
    "timeout": ("timeout", "deadline exceeded", "timed out"),
    "refused": ("connection refused", "connection reset", "no route to host", "network is unreachable"),
    "skip": ("skip", "congested"),
    "tls": ("tls:", "x509:", "certificate"),
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """Search tokens: words of 2 to 50 bytes that aren't stop words."""
    return F.filter(words(text), lambda t: F.octet_length(t).between(2, 50) & ~t.isin(*STOPWORDS))


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def collapse_space(text: Column) -> Column:
    """One space for each run of blanks, one line end for each run with a line end, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r" ?\n[\n ]*", "\n"))


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line in a row."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def snippet(text: Column, size: int = 500) -> Column:
    return F.substring(text, 1, size)


def spam_score(text: Column) -> Column:
    """A tenth for each spam phrase in the text, 1 at most; 0 without words."""
    low = F.lower(text)
    hits = sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in SPAM_PHRASES), F.lit(0))
    return F.when(~text.rlike(r"\S"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), hits * 0.1))


def is_parked(title: Column, body: Column, n: Column | None = None) -> Column:
    """Short pages that say so; n is the body's word count if it is known."""
    return ((word_count(body) if n is None else n) <= 150) & F.concat_ws(" ", title, body).rlike(PARKED)


QUALITY = ("word_count", "title_length", "has_main_content", "is_short_content", "spam_score", "is_parked")


def quality_signals(pages: DataFrame, title: str, body: str) -> DataFrame:
    """pages with the signals; words are counted once, in a projection of their own."""
    n = F.col("word_count")
    return pages.withColumn("word_count", word_count(F.col(body))).withColumns(
        {
            "title_length": F.char_length(title),
            "has_main_content": n >= 50,
            "is_short_content": n < 50,
            "spam_score": spam_score(F.concat_ws(" ", title, body)),
            "is_parked": is_parked(F.col(title), F.col(body), n),
        }
    )


def error_class(message: Column, tls: bool = True) -> Column:
    """dns, timeout, refused, skip, tls or other."""
    low, found = F.lower(message), F.lit("other")
    for name, parts in reversed(ERROR_CLASSES.items()):
        if name != "tls" or tls:
            hit = F.lit(False)
            for part in parts:
                hit = hit | F.contains(low, F.lit(part))
            found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def error_fingerprint(message: Column) -> Column:
    """What kind of failure a message tells of: without the request, its numbers and URLs; about 120 characters."""
    low = F.lower(F.trim(message))
    bare = F.regexp_replace(low, r'^[^"]*".*?": ', "")
    kind = lambda t: F.when(t.rlike(r"\p{Nd}"), "N").when(t.rlike("^https?://"), "URL").otherwise(t)
    made = F.array_join(F.transform(F.filter(F.split(bare, r"\s+"), lambda t: t != ""), kind), " ")
    head = F.substring(made, 1, 120)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    short = F.concat(F.when(F.instr(head, " ") > 1, F.substr(head, F.lit(1), at)).otherwise(head), F.lit(" ..."))
    return F.when(F.length(made) > 120, short).otherwise(made)


def slug(text: Column) -> Column:
    """Lower case; one dash for whatever isn't a-z, 0-9, dash or underscore; no dashes at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_-]", "-"), F.lit("-"))


def loose_timestamp(text: str, upper: bool) -> str:
    """14 digits for a date of any precision: the least or the greatest that it covers; empty without digits."""
    digits = "".join(c for c in text if c in "0123456789")
    fill = "99991231235959" if upper else "0" * 14
    return digits[:14] if len(digits) >= 14 else digits and digits + fill[len(digits) :]


def language_sample(text: Column, size: int | None = None) -> Column:
    """Prose for a language identifier: without link targets, tags, URLs and markup; its first `size` characters, or all."""
    made = F.regexp_replace(text, r"\]\([^)]*\)?", "] ")
    made = F.regexp_replace(made, r"<[^>]*>?", " ")
    made = F.regexp_replace(made, r"(^|\s)(https?://|www\.|javascript:)[^\s)]*", "$1 ")
    made = F.regexp_replace(made, r"[#*_|`\[\]\s]", " ")
    return made if size is None else F.substring(made, 1, size)
