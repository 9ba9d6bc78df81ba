"""Secrets in text, found by the parts that text is made of.

A text is cut into words and the gaps between them, and each word is judged by what it is made of and by the words before it: a value that a
secret name assigns, a bearer's token, the user of an address, the parameters of a query, or a key that shows by its first part. Names
are compared by their letters alone, so spelling, quotes and hyphens don't matter. All of it is array functions of the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of secrets, by their letters; a name counts if it ends so.
NAMES = ("apikey", "accesstoken", "authtoken", "password", "passwd", "secret")
#: Names of parameters, by their letters.
PARAMETERS = ("apikey", "accesstoken", "token", "key", "secret", "password")
#: First parts of services' keys, and how many characters follow at least.
FIRST_PARTS, LEAST = ("sk", "rk", "pk", "or", "ds"), 12
MASK = "[REDACTED]"


def _letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))


def _is_name(c: Column) -> Column:
    letters = _letters(c)
    found = F.lit(False)
    for n in NAMES:
        found = found | letters.endswith(n)
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _assigned(word: Column) -> Column:
    """word with all behind its first assignment to a secret name masked; null if it has none or nothing behind it."""

    def cut(sides: Column) -> Column:
        place = F.array_position(F.transform(F.slice(sides, 1, F.size(sides) - 1), _is_name), True).cast("int")
        return F.when(place > 0, F.length(F.array_join(F.slice(sides, 1, place), ".")) + 1)

    head = _let(F.split(word, "[:=]"), cut)
    masked = _let(head, lambda n: F.when(F.length(word) > n, F.concat(F.substr(word, F.lit(1), n), F.lit(MASK))))
    return F.when(word.rlike("[:=]"), masked)


def _awaits(word: Column) -> Column:
    """Whether a word ends in the sign that assigns to a secret name."""
    return F.right(word, F.lit(1)).isin(":", "=") & _is_name(F.element_at(F.split(F.concat(F.lit(" :"), F.left(word, F.length(word) - 1)), "[:=]"), -1))


def _address(word: Column) -> Column:
    """word with the user part of an address masked."""

    def parts(start: Column) -> Column:
        return _let(F.regexp_extract(F.substr(word, start), "^[^/?#]*", 0), lambda host: F.when(F.contains(host, F.lit("@")), F.concat(F.left(word, start - 1), F.lit(f"{MASK}@"), F.substring_index(host, "@", -1), F.substr(word, start + F.length(host)))).otherwise(word))

    return F.when(F.contains(word, F.lit("://")), _let(F.instr(word, "://") + 3, parts)).otherwise(word)


def _query(word: Column) -> Column:
    """word with the values of secret parameters masked."""

    def masked(parts: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            name = F.substring_index(p, "=", 1)
            return F.when(F.get(parts, i - 1).isin("?", "&") & F.contains(p, F.lit("=")) & _letters(name).isin(*PARAMETERS), F.concat(name, F.lit(f"={MASK}"))).otherwise(p)

        return F.array_join(F.transform(parts, part), "")

    return F.when(word.rlike("[?&][^=]*="), _let(F.regexp_extract_all(word, F.lit("[?&#]|[^?&#]+"), F.lit(0)), masked)).otherwise(word)


def _keys(word: Column) -> Column:
    """word with keys masked: a first part, a hyphen, and LEAST characters more."""

    def placed(parts: Column, place: Column) -> Column:
        head, rest = F.array_join(F.slice(parts, 1, place - 1), "-"), F.array_join(F.slice(parts, place + 1, F.size(parts)), "-")
        return F.when(F.length(rest) >= LEAST, F.concat(head, F.when(place > 1, "-").otherwise(""), F.lit(MASK)))

    def run(r: Column) -> Column:
        first = lambda parts: F.array_position(F.transform(parts, lambda p: F.lower(p).isin(*FIRST_PARTS)), True).cast("int")
        found = _let(F.split(r, "-"), lambda parts: _let(first(parts), lambda place: F.when(place > 0, placed(parts, place))))
        return F.when(F.contains(r, F.lit("-")), F.coalesce(found, r)).otherwise(r)

    return F.when(F.contains(word, F.lit("-")), F.array_join(F.transform(F.regexp_extract_all(word, F.lit(r"[-\w]+|[^-\w]+"), F.lit(0)), run), "")).otherwise(word)


def _masked(words: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        near = F.get(words, i - 1).rlike(r"^\s+$")
        before = F.get(words, i - 2)
        given = _awaits(before) | (before.isin(":", "=") & F.get(words, i - 3).rlike(r"^\s+$") & _is_name(F.get(words, i - 4)))
        bearer = _letters(before).endswith("bearer") & F.lower(F.right(before, F.lit(1))).isin("r")
        led = F.left(w, F.lit(1)).isin(":", "=") & (F.length(w) > 1) & _is_name(before)
        behind = F.when(near & ~w.isin(":", "=") & (given | bearer), MASK).when(near & led, F.concat(F.left(w, F.lit(1)), F.lit(MASK)))
        own = _let(_address(w), lambda a: _let(_query(a), _keys))
        return F.when(w.rlike(r"^[\s;,]"), w).otherwise(F.coalesce(behind, _assigned(w), F.when(w.rlike("[-=@]"), own), w))

    return F.array_join(F.transform(words, word), "")


def redacted(c: Column, home: str | None = None) -> Column:
    """c with each secret masked and what introduces it kept. home: a directory to write as ~."""
    words = F.regexp_extract_all(c, F.lit(r"[\s;,]+|[^\s;,]+"), F.lit(0))
    cue = c.rlike("(?i)[:=]|bearer|(?:" + "|".join(FIRST_PARTS) + ")-")
    c = F.when(cue, _let(words, _masked)).otherwise(c)
    return F.replace(c, F.lit(home), F.lit("~")) if home else c
