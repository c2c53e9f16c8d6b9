r"""Unicode text helpers.

Java's `\w` under `(?U)` also takes combining marks, connectors and joiners;
the audit counts words the way a letters-digits-underscore rule does, so the
classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
WORD_START = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])"
WORD_END = r"(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])"
SPACE = r"(?U:[\s\x1c-\x1f])"


_BUILT: dict = {}


def built_once(build: Callable) -> Callable:
    """Keep the columns a function returns, per argument and driver connection.

    A column is a value that belongs to no table; assembling one of a few
    hundred nodes costs a driver round trip per node.
    """

    @wraps(build)
    def cached(*args):
        gateway = SparkContext._gateway
        if _BUILT.get("gateway") is not gateway:
            _BUILT.clear()
            _BUILT["gateway"] = gateway
        key = (build.__module__, build.__qualname__, args)
        if key not in _BUILT:
            _BUILT[key] = build(*args)
        return _BUILT[key]

    return cached


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value` computed once: keeps a long expression from being copied wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+"))


# All Unicode white space and the four information separators.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def words_from(words: list[str]) -> str:
    """Pattern for any of `words` at the start of a word.

    The first letter is tested before the look-behind and the alternatives: a
    search tries the pattern at every position of a page.
    """
    firsts = "".join(dict.fromkeys(w[0] for w in words))
    rests = "|".join(f"(?<={w[0]}){w[1:]}" for w in words)
    return rf"[{firsts}](?<![\p{{L}}\p{{N}}_][{firsts}])(?:{rests})"


def any_word_of(words: list[str]) -> str:
    """Pattern for any of `words` standing alone."""
    return words_from(words) + WORD_END


def plain_count(n: Column, singular: str, plural: str | None = None) -> Column:
    """`3 lists`, `1 list`."""
    return F.concat(
        n.cast("string"), F.when(n == 1, f" {singular}").otherwise(f" {plural or singular + 's'}")
    )
