"""Column expressions on text, paths and markup."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " "
WORD_BREAKS = "[^a-z0-9]+"


def tokens(text: Column | str, pattern: str = BLANK, stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased tokens of a text, empty tokens dropped, repeats kept.

    The default breaks on single blanks, so line ends and punctuation stay inside tokens;
    pass ``WORD_BREAKS`` for plain words.
    """
    text = F.col(text) if isinstance(text, str) else text
    split = F.split(F.lower(text), pattern)
    stop = sorted(set(stop_words))
    if stop:
        return F.filter(split, lambda t: (t != "") & ~t.isin(stop))
    return F.filter(split, lambda t: t != "")


def base_name(path: Column | str) -> Column:
    """Last path segment without query string, fragment and final suffix."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(F.regexp_replace(path, "[?#].*$", ""), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def flat_key(path: Column | str) -> Column:
    """A path as one flat name: every slash becomes a dash."""
    path = F.col(path) if isinstance(path, str) else path
    return F.replace(path, F.lit("/"), F.lit("-"))


def one_line(text: Column | str) -> Column:
    """Text with each line end turned into one blank."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.translate(text, "\n", " "))


def page_title(html: Column | str) -> Column:
    """Content of the first title element."""
    html = F.col(html) if isinstance(html, str) else html
    return unescape(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))


def page_text(html: Column | str) -> Column:
    """Body of a page on one line: scripts, styles, comments and tags removed."""
    html = F.col(html) if isinstance(html, str) else html
    bare = html
    for noise in ("(?is)<head.*?</head>", "(?is)<script.*?</script>", "(?is)<style.*?</style>",
                  "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        bare = F.regexp_replace(bare, noise, " ")
    return one_line(unescape(bare))


def unescape(text: Column) -> Column:
    """Replace the basic character references."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text
