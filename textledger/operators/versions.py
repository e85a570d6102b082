"""Contents of files at any recorded version, by taking changes back from what the files hold now.

A version of a path is looked for from its newest state back: along the path's changes to the last file
that was moved there, then along that file's changes where it was before; where no file was moved there, to
what the path held before it moved away. Each segment (see lifelines) so has one segment behind it, and
a request is the chain of these. Its candidates are the changes whose version before is the one wanted.

The files of one root are read newest change first, as a stream with the lines of its files in memory: a
change costs its fragments, and only the contents that a candidate asks for come out. Fragments whose
lines don't stand where they should, and binary changes, break a file's chain there; what lies behind is found
only where another path's history holds it. Changes of style
(byte order mark, line ends, final newline) leave no fragments, so a content is rendered in all of them until
its hash is the version wanted. A root's changes depend on each other and are one task's stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import durable
from .lifelines import next_moves, roots

FOUND = "change_id long, version string, content string"
NOW, OWN, AWAY = 2, 1, 0


def version_of(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()[:6]


class Doc:
    """Lines, each with the carriage return of its ending, and the style of a file."""

    def __init__(self, lines: list[str], bom: bool = False, crlf: bool = False, final: bool = True) -> None:
        self.lines, self.bom, self.crlf, self.final = lines, bom, crlf, final

    @classmethod
    def of(cls, content: str) -> Doc:
        bom = content.startswith(T.BOM)
        lines = content[bom:].split("\n")
        final = lines[-1] == ""
        if final:
            lines.pop()
        return cls(lines, bom, 2 * sum(x.endswith("\r") for x in lines) > len(lines), final and bool(lines))

    def unapply(self, fragments: list[tuple[int, list[str], list[str]]]) -> bool:
        """Takes back fragments (pos, old, new) in order; whether their lines stood there."""
        shift, todo = 0, []
        for pos, old, new in fragments:
            at = pos + shift
            if at < 0 or [x.removesuffix("\r") for x in self.lines[at : at + len(new)]] != new:
                return False
            todo.append((at, old, len(new)))
            shift += len(new) - len(old)
        for at, old, size in reversed(todo):
            self.lines[at : at + size] = [x + "\r" for x in old] if self.crlf else old
        return True

    def content(self, version: str) -> str | None:
        """The lines in the style that has this version, the file's own first."""
        own = (T.BOM if self.bom else "") + "\n".join(self.lines) + ("\n" if self.final and self.lines else "")
        if version_of(own) == version:
            return own
        plain = [x.removesuffix("\r") for x in self.lines]
        for end, bom, final in product(("\n", "\r\n"), ("", T.BOM), (True, False)):
            text = bom + end.join(plain) + (end if final and plain else "")
            if version_of(text) == version:
                self.bom, self.crlf, self.final = bool(bom), end == "\r\n", final
                self.lines = [x + "\r" for x in plain] if self.crlf else plain
                if not final and self.crlf and plain:
                    self.lines[-1] = plain[-1]
                return text
        return None


def _back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root, docs, broken = None, {}, set()
    for rows in _steps(frames):
        c = rows.iloc[0]
        if c["root"] != root:
            root, docs, broken = c["root"], {}, set()
        kind, segment, to = int(c["kind"]), int(c["segment"]), int(c["to"])
        if kind == NOW:
            if c["content"] is not None:
                docs[segment] = Doc.of(c["content"])
            continue
        if kind == AWAY:  # what the target held is what the source had
            if to in docs:
                docs[segment] = docs.pop(to)
            else:
                broken.add(segment)
            if to in broken:
                broken.add(segment)
            broken.discard(to)
        elif not c["moved"] and segment not in broken:
            pieces = [(int(p), list(o), list(n)) for p, o, n in zip(rows["pos"], rows["old"], rows["new"], strict=True) if p >= 0]
            if c["removed"]:
                good = segment not in docs and not c["binary"]
                docs.setdefault(segment, Doc([]))
            else:
                good = segment in docs and not c["binary"]
            if not good or not docs[segment].unapply(pieces):
                broken.add(segment)
                docs.pop(segment, None)
            elif c["created"]:
                docs.pop(segment)
        if c["wanted"] and segment in docs:
            content = docs[segment].content(c["v_before"])
            if content is not None:
                yield pd.DataFrame([(int(c["at"]), c["v_before"], content)], columns=["change_id", "version", "content"])


def _steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stream cut at (root, change, kind); a change with many fragments stays together."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        names = frame[["root", "at", "kind"]]
        cut = (names != names.shift()).any(axis=1).to_numpy().nonzero()[0]
        for a, b in zip(cut, cut[1:], strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[cut[-1] :] if len(cut) else rest
    if rest is not None and len(rest):
        yield rest


def chains(requests: DataFrame, located: DataFrame) -> DataFrame:
    """(req_id, depth, path, end, since) of the segments that a request looks through, newest first, each back to change `since`."""
    own = located.withColumn("arrived", F.col("from_path").isNotNull())
    latest = own.where("arrived").groupBy("path", "end").agg(F.max("change_id").alias("came"))
    came_from = own.where("arrived").select(F.col("change_id").alias("came"), F.col("from_path").alias("source"))
    away = own.where("arrived").select(F.col("from_path").alias("path"), F.col("change_id").alias("move"))
    w = Window.partitionBy("path").orderBy("move")
    earlier = away.withColumn("before", F.lag("move").over(w))  # the moves away from a path
    last = away.groupBy("path").agg(F.max("move").alias("last"))
    links = durable(latest.join(came_from, "came").select("path", "end", "came", "source"))
    now = durable(requests.select("req_id", "path").withColumns({"end": F.lit(None).cast("long"), "depth": F.lit(0)}))
    out = None
    while not now.isEmpty():
        rows = now.alias("n").join(links.alias("l"), (F.col("n.path") == F.col("l.path")) & F.col("n.end").eqNullSafe(F.col("l.end")), "left")
        rows = rows.select("n.*", "came", "source")
        # Without an arrival the path held something else before it moved away.
        rows = rows.join(earlier.withColumnRenamed("move", "end"), ["path", "end"], "left").join(last, "path", "left")
        previous = F.when(F.col("end").isNull(), F.col("last")).otherwise(F.col("before"))
        rows = durable(rows.withColumn("previous", previous))
        seen = rows.select("req_id", "depth", "path", "end", F.coalesce("came", F.lit(0)).alias("since"))
        out = seen if out is None else out.unionByName(seen)
        arrived = F.col("came").isNotNull()
        further = rows.select("req_id", F.when(arrived, F.col("source")).otherwise(F.col("path")).alias("path"), F.when(arrived, F.col("came")).otherwise(F.col("previous")).alias("end"), (F.col("depth") + 1).alias("depth"))
        now = durable(further.where("end is not null"))
    return out


def reconstructed(requests: DataFrame, changes: DataFrame, fragments: DataFrame, files: DataFrame) -> DataFrame:
    """(req_id, status, path, change_id, content) of requests (req_id, path, v).

    changes: (change_id, path, from_path, created, removed, binary, v_before, v_after); fragments: (change_id, seq,
    pos, old, new) with lines; files: (path, content) now. status: current, found (content is what the file at
    `path` held before change_id) or not_found.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    changes = changes.select("change_id", "path", "from_path", plain("created"), plain("removed"), plain("binary"), "v_before", "v_after")
    located = durable(next_moves(changes.withColumn("at", F.col("change_id")), changes.where("from_path is not null")))
    root_of = durable(roots(located.where("from_path is not null")))
    # Found by the versions alone: contents are read for the result only.
    at_once = durable(files.select("path", T.content_version(F.col("content")).alias("v")).join(requests, ["path", "v"]).select("req_id", "path"))
    current = files.join(at_once, "path").select("req_id", F.lit("current").alias("status"), "path", F.lit(None).cast("long").alias("change_id"), "content")
    open_ = durable(requests.join(at_once.select("req_id"), "req_id", "left_anti"))

    chain = chains(open_, located).alias("c")
    # A move shows the version where the file was: as the change that ends the segment it left.
    before = located.select("change_id", "path", "end", "v_before", F.lit(False).alias("left")).where("from_path is null")
    left = located.where("from_path is not null").select("change_id", F.col("from_path").alias("path"), F.col("change_id").alias("end"), "v_before", F.lit(True).alias("left"))
    spots = before.unionByName(left).alias("b")
    same = (F.col("c.path") == F.col("b.path")) & F.col("c.end").eqNullSafe(F.col("b.end")) & (F.col("b.change_id") > F.col("since"))
    candidates = chain.join(open_.alias("r"), "req_id").join(spots, same & (F.col("v_before") == F.col("v")))
    candidates = durable(candidates.select("req_id", "depth", "change_id", "b.path", "left"))

    number = F.coalesce("end", F.lit(-1)).alias("segment")
    rooted = lambda rows: rows.join(root_of, "end", "left").withColumn("root", F.coalesce("root", "path"))
    asked = candidates.select("change_id", "left").distinct().withColumn("wanted", F.lit(True))
    marked = rooted(located)
    lines = F.array().cast("array<string>")
    columns = ["root", "at", "kind", "segment", "to", "created", "removed", "binary", "moved", "v_before", "wanted", "content", "pos", "old", "new"]
    no, none = F.lit(False), F.lit(None).cast("string")
    pieces = marked.join(fragments.select("change_id", "pos", "old", "new"), "change_id", "left").join(asked.where("not left").drop("left"), "change_id", "left")
    own = pieces.select("*", F.lit(OWN).alias("kind"), number, F.lit(-1).cast("long").alias("to"), F.col("from_path").isNotNull().alias("moved"), none.alias("content"))
    own = own.withColumns({"wanted": F.coalesce("wanted", no), "pos": F.coalesce("pos", F.lit(-1)).cast("long"), "old": F.coalesce("old", lines), "new": F.coalesce("new", lines)}).select(*columns)
    moved = marked.where("from_path is not null").join(asked.where("left").drop("left"), "change_id", "left")
    moved = moved.select("root", "at", F.lit(AWAY).alias("kind"), F.col("change_id").alias("segment"), F.coalesce("end", F.lit(-1)).alias("to"), "created", "removed", "binary", F.lit(True).alias("moved"), "v_before", F.coalesce("wanted", no).alias("wanted"), none.alias("content"), F.lit(-1).cast("long").alias("pos"), lines.alias("old"), lines.alias("new"))
    # Only roots with a candidate, back to their first one.
    needed = marked.join(asked.select("change_id").distinct(), "change_id").groupBy("root").agg(F.min("change_id").alias("oldest"))
    held = files.withColumnRenamed("path", "root").select(
        "root", F.lit((1 << 63) - 1).alias("at"), F.lit(NOW).alias("kind"), F.lit(-1).cast("long").alias("segment"), F.lit(-1).cast("long").alias("to"), no.alias("created"), no.alias("removed"), no.alias("binary"), no.alias("moved"),
        none.alias("v_before"), no.alias("wanted"), "content", F.lit(-1).cast("long").alias("pos"), lines.alias("old"), lines.alias("new"),
    )
    stream = own.unionByName(moved).unionByName(held).join(needed, "root").where("at >= oldest").drop("oldest")
    order = [F.col("root"), F.desc("at"), F.col("kind"), F.col("pos")]
    found = stream.repartition("root").sortWithinPartitions(*order).mapInPandas(_back, FOUND)

    first = Window.partitionBy("req_id").orderBy("depth", F.desc("change_id"))
    best = candidates.join(found, "change_id").withColumn("n", F.row_number().over(first)).where("n = 1")
    best = best.select("req_id", F.lit("found").alias("status"), "path", "change_id", "content")
    best = durable(best)
    done = current.unionByName(best)
    missing = open_.join(best.select("req_id"), "req_id", "left_anti").select("req_id", F.lit("not_found").alias("status"), "path", F.lit(None).cast("long").alias("change_id"), none.alias("content"))
    return done.unionByName(missing)
