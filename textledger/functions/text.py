"""Column expressions over texts, lines, words and identifiers."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
TRIGRAM_LIMIT = 12
WORD = r"[\p{L}\p{Nd}]+"
CAMEL = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: A word with a place where CAMEL splits.
HUMP = r"[\p{Ll}\p{Nd}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"
#: Words whose parts a task keeps.
MOST_WORDS = 200_000
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def without_bom(content: Column) -> Column:
    return F.when(F.startswith(content, F.lit(BOM)), F.substring(content, 2, F.length(content))).otherwise(content)


def split_lines(content: Column) -> Column:
    """Lines without endings: no BOM, no \\r before \\n, no empty line behind a final newline, '' has none."""
    body = without_bom(content)
    lines = F.split(body, "\n", -1)
    last = F.element_at(lines, -1)
    # A carriage return is part of an ending only if a newline follows.
    ended = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))


def line_count(content: Column) -> Column:
    body = without_bom(content)
    newlines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return newlines + F.when((body != "") & ~F.endswith(body, F.lit("\n")), 1).otherwise(0)


def line_format(content: Column) -> Column:
    """eol (crlf if more than half of the endings), mixed, bom, final_newline."""
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    crlf = (F.length(content) - F.length(F.replace(content, F.lit("\r\n"), F.lit("")))) / 2
    return F.struct(
        F.when(crlf * 2 > n, "crlf").otherwise("lf").alias("eol"),
        ((crlf > 0) & (crlf < n)).alias("mixed"),
        F.startswith(content, F.lit(BOM)).alias("bom"),
        F.endswith(content, F.lit("\n")).alias("final_newline"),
    )


def join_lines(lines: Column, form: Column) -> Column:
    eol = F.when(form["eol"] == "crlf", "\r\n").otherwise("\n")
    return F.concat(
        F.when(form["bom"], BOM).otherwise(""),
        F.when(form["eol"] == "crlf", F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n")),
        F.when(form["final_newline"] & (F.size(lines) > 0), eol).otherwise(""),
    )


def is_text(content: Column) -> Column:
    """Valid UTF-8 without NUL; content is binary or string."""
    return F.is_valid_utf8(content.cast("string")) & (F.instr(content.cast("string"), "\0") == 0)


def content_version(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 6)


def is_version(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{6}$")


def line_hash(line: Column) -> Column:
    """Three base-62 characters from the line's SHA-256; a final carriage return doesn't count."""
    n = F.conv(F.substring(F.sha2(F.regexp_replace(line, "\r$", ""), 256), 1, 12), 16, 10).cast("long") % (62**3)
    digit = lambda k: F.substring(F.lit(BASE62), (F.floor(n / (62**k)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(digit(2), digit(1), digit(0))


def anchor(text: Column) -> Column:
    """'12' or '12:aB3' as (line_no, line_hash, reason); reason tells why it isn't one."""
    good = text.rlike("^[0-9]+(:[0-9A-Za-z]{3})?$")
    line = F.when(good, F.try_to_number(F.regexp_extract(text, "^([0-9]+)", 1), F.lit("999999999")).cast("int"))
    return F.struct(
        F.when(line > 0, line).alias("line_no"),
        F.when((line > 0) & F.contains(text, F.lit(":")), F.regexp_extract(text, ":(.*)$", 1)).alias("line_hash"),
        F.when(text.isNull() | (text == ""), "empty").when(~good, "malformed").when(~F.coalesce(line > 0, F.lit(False)), "line must be at least 1").alias("reason"),
    )


def folded(gram: Column) -> Column:
    """Three characters, each lower-cased alone: what a letter becomes must not depend on its neighbours, which a query's text cuts off."""
    each = F.concat(*[F.lower(F.substring(gram, k, 1)) for k in (1, 2, 3)])
    return F.when(F.octet_length(gram) == 3, F.lower(gram)).otherwise(each)


@functools.cache
def folds(spark: SparkSession) -> dict[str, str]:
    """The characters that Spark's lower-casing of one alone changes, some 1,400, and into what."""
    rows = each_char(spark).select("id", "char", F.lower("char").alias("low")).where("low <> char")
    return {chr(r.id): r.low for r in rows.collect()}


def each_char(spark: SparkSession) -> DataFrame:
    """(id, char) of all characters."""
    point = F.col("id")
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return spark.range(0x110000).where(~point.between(0xD800, 0xDFFF)).select("id", char.alias("char"))


@functools.cache
def kinds(spark: SparkSession) -> dict[str, str]:
    """Sets of characters for regular expressions, as Spark's have them: Lu, Ll, Nd, and word for all letters and Nd."""
    classes = {"word": r"[\p{L}\p{Nd}]", "Lu": r"\p{Lu}", "Ll": r"\p{Ll}", "Nd": r"\p{Nd}"}
    rows = each_char(spark).select("id", *[F.col("char").rlike(f"^{p}$").alias(k) for k, p in classes.items()]).where("word").toArrow()
    out = {}
    for kind in classes:
        ids, ranges = rows.filter(rows[kind])["id"].to_pylist(), []
        for i in sorted(ids):
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
        out[kind] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return out


class WordParts(dict):
    """words_text of single words, kept for those met before."""

    def __init__(self, folds: dict[str, str], kinds: dict[str, str]) -> None:
        up, low, digit = kinds["Lu"], kinds["Ll"], kinds["Nd"]
        self.hump = re.compile(f"[{low}{digit}][{up}]|[{up}][{up}][{low}]").search
        self.camel = re.compile(f"(?<=[{low}{digit}])(?=[{up}])|(?<=[{up}])(?=[{up}][{low}])").split
        self.table = str.maketrans(folds)

    def lower(self, word: str) -> str:
        return word.lower() if word.isascii() or "Σ" in word else word.translate(self.table)

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= MOST_WORDS:
            self.clear()
        # Sets of all letters are slow, and most words are lower-case behind their first letter.
        out = [word if word.islower() else self.lower(word)]
        if not word[1:].islower() and self.hump(word):
            out += map(self.lower, self.camel(word))
        self[word] = out
        return out


def word_counter(folds: dict[str, str], kinds: dict[str, str]) -> Callable[[str], Counter]:
    """How often a text has each of its words_text, for the texts in a task."""
    parts = WordParts(folds, kinds)
    near = "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", kinds["word"]) if r <= "\\U0000ffff")
    # Sets with characters behind U+FFFF are slow.
    plain, near, far = (re.compile(f"[{chars}]+").findall for chars in ("A-Za-z0-9", near, kinds["word"]))

    def read(text: str) -> Counter:
        words = plain if text.isascii() else near if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else far
        out = Counter()
        for word, n in Counter(words(text)).items():
            for token in parts[word]:
                out[token] += n
        return out

    return read


def trigrams(text: Column) -> Column:
    """Distinct 3-grams, folded, in order of first place."""
    # A match of every character, whole if it is two UTF-16 units, whose lookahead captures three: linear in the line.
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))."), F.lit(1)))
    return F.array_distinct(F.transform(grams, folded))


def query_trigrams(text: Column) -> Column:
    """At most 12 of a query's trigrams, evenly spread."""
    all_ = trigrams(text)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(TRIGRAM_LIMIT - 1)),
        lambda k: F.element_at(all_, (F.floor(k * (F.size(all_) - 1) / (TRIGRAM_LIMIT - 1)) + 1).cast("int")),
    )
    return F.when(F.size(all_) > TRIGRAM_LIMIT, F.array_distinct(spread)).otherwise(all_)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def camel_parts(word: Column) -> Column:
    return F.split(word, CAMEL)


def words_text(text: Column) -> Column:
    """Every word, lower-cased, followed by its camelCase parts if it has several."""

    def expand(w: Column) -> Column:
        parts = F.transform(camel_parts(w), lambda p: F.lower(p))
        return F.when(w.rlike(HUMP), F.concat(F.array(F.lower(w)), parts)).otherwise(F.array(F.lower(w)))

    return F.when(lowers_whole(text) & ~text.rlike(HUMP), word_tokens(F.lower(text))).otherwise(F.flatten(F.transform(word_tokens(text), expand)))


def lowers_whole(text: Column) -> Column:
    """Whether a text's words are the same lower-cased with it as alone: a sigma depends on its neighbours, and a dotted I gets a mark."""
    return ~(F.contains(text, F.lit("Σ")) | F.contains(text, F.lit("İ")))


def plain_words(text: Column) -> Column:
    """Every word, lower-cased."""
    return F.when(lowers_whole(text), word_tokens(F.lower(text))).otherwise(F.transform(word_tokens(text), lambda w: F.lower(w)))


def line_score(line: Column, terms: Column) -> Column:
    """2 for each query term that stands whole in the line, 1 if only all its parts do. terms: (whole, parts)."""
    return words_score(plain_words(line), words_text(line), terms)


def words_score(plain: Column, words: Column, terms: Column) -> Column:
    """line_score of a line's plain_words and words_text."""

    def add(total: Column, t: Column) -> Column:
        parts = (F.size(t["parts"]) > 1) & (F.size(F.array_except(t["parts"], words)) == 0)
        return total + F.when(F.array_contains(plain, t["whole"]), 2).when(parts, 1).otherwise(0)

    return F.aggregate(terms, F.lit(0), add)


def query_terms(query: Column) -> Column:
    """A query's words, each once by its lower-case form, with their lower-case parts."""
    pairs = F.transform(
        word_tokens(query),
        lambda w: F.struct(F.lower(w).alias("whole"), F.transform(camel_parts(w), lambda p: F.lower(p)).alias("parts")),
    )
    wholes = F.transform(pairs, lambda p: p["whole"])
    return F.filter(pairs, lambda p, i: F.array_position(wholes, p["whole"]) == i + 1)


def cut_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def format_size(n: Column) -> Column:
    """310B, 7.6K, 1.2M, 3.4G."""
    tenth = lambda unit: F.format_string("%.1f", F.floor(n * 10 / unit + 0.5) / 10)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1 << 20, F.concat(tenth(1 << 10), F.lit("K")))
        .when(n < 1 << 30, F.concat(tenth(1 << 20), F.lit("M")))
        .otherwise(F.concat(tenth(1 << 30), F.lit("G")))
    )


def ranges_text(ranges: Column) -> Column:
    """12-18,30,41(del): inclusive ranges; one that ends before its start is a place."""

    def one(r: Column) -> Column:
        return (
            F.when(r["end"] < r["start"], F.concat(r["start"].cast("string"), F.lit("(del)")))
            .when(r["end"] == r["start"], r["start"].cast("string"))
            .otherwise(F.concat_ws("-", r["start"], r["end"]))
        )

    return F.array_join(F.transform(ranges, one), ",")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def common_affix(old: Column, new: Column) -> Column:
    """(prefix, suffix): how many lines two versions share at the start and, behind that, at the end."""

    def apart(v: Column, n: Column, back: bool) -> Column:
        """How many of the n first (last) lines are equal up to the first difference."""
        places = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: (i <= n) & (F.element_at(v["a"], -i if back else i) != F.element_at(v["b"], -i if back else i)),
        )
        return F.coalesce(F.get(places, F.lit(0)) - 1, n)

    def with_prefix(v: Column) -> Column:
        short = F.least(F.size(v["a"]), F.size(v["b"]))
        return let(
            apart(v, short, False),
            lambda p: F.struct(p.cast("int").alias("prefix"), apart(v, short - p, True).cast("int").alias("suffix")),
        )

    return let(F.struct(old.alias("a"), new.alias("b")), with_prefix)
