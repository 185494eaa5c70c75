"""Fixity audit of archived web records: Merkle trees over ordered offset ranges of two replicas.

A record is a WARC response: headers and the page. Its digest is a leaf. Leaves
of an archive file lie in ranges of offsets, ranges hash into nodes of
``FANOUT`` ranges, and so on to one root a file. Roots of two replicas are
compared, and only below nodes that differ are children compared, down to the
records. All of it is SQL functions; what is shuffled are digests, never pages.

Archive files hold a bounded number of records, by where a row lies in its input
file, so neither a site with very many pages nor repeated or NULL ids make a
file too large. A NULL url or page is empty. A record that one replica lacks is
reported as missing or extra, and those behind it, which stand at other offsets, are
matched by their digests. Empty tables have no roots and no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FILE_RECORDS = 4_096
RANGE_BYTES, FANOUT = 65_536, 16


def response_record(url: Column, body: Column) -> Column:
    """The bytes of a WARC response record."""
    link, page = (F.coalesce(c.cast("string"), F.lit("")) for c in (url, body))
    size = F.octet_length(page).cast("string")
    return F.encode(F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), link, F.lit("\r\nContent-Length: "), size,
        F.lit("\r\n\r\n"), page, F.lit("\r\n\r\n"),
    ), "utf-8")


def archived(pages: DataFrame) -> DataFrame:
    """Pages of a Parquet table as records of archive files; other columns stay."""
    place = F.col("_metadata.row_index")
    name = F.concat_ws("-", F.col("_metadata.file_name"), F.floor(place / FILE_RECORDS).cast("string"))
    record = response_record(F.col("url"), F.col("html"))
    # Columns of these names make room.
    return pages.withColumns({"archive": name, "position": place, "record": record})


def leaves(records: DataFrame, keep: list[str]) -> DataFrame:
    """Digest, offset and length of every record."""
    before = Window.partitionBy("archive").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    narrow = records.select(
        "archive", "position", *keep, F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")
    )
    return narrow.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("position")


def _parents(level: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(
        F.sha2(F.to_json(children), 256).alias("digest")
    )


def tree(leaf: DataFrame, height: int) -> list[DataFrame]:
    """Nodes by level: ranges of records first, roots last."""
    kept = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    ranges = leaf.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("node")).agg(
        F.sha2(F.to_json(kept), 256).alias("digest")
    )
    levels = [cut(ranges)]
    for _ in range(height):
        levels.append(cut(_parents(levels[-1])))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which the replicas have different digests, or only one has any."""
    a = ours.select(*keys, F.col("digest").alias("_ours"))
    b = theirs.select(*keys, F.col("digest").alias("_theirs"))
    return a.join(b, keys, "full").filter(~F.col("_ours").eqNullSafe(F.col("_theirs")))


def _below(level: DataFrame, nodes: DataFrame, parent: Column) -> DataFrame:
    """Rows of a level under nodes that differ."""
    marked = nodes.select("archive", F.col("node").alias("_above"))
    return level.withColumn("_above", parent).join(marked, ["archive", "_above"], "left_semi").drop("_above")


def audit(primary: DataFrame, replica: DataFrame, keep: list[str]) -> DataFrame:
    """Records of which two replicas' leaves differ: archive, offset, length, kept columns and what is wrong."""
    ours, theirs = cut(primary), cut(replica)
    last = max(x.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for x in (ours, theirs)) // RANGE_BYTES
    height = 0
    while last:
        last, height = last // FANOUT, height + 1
    levels = list(zip(tree(ours, height), tree(theirs, height)))
    wrong = cut(_differing(*levels[-1], ["archive", "node"]))
    for a, b in levels[-2::-1]:
        parent = F.floor(F.col("node") / FANOUT)
        wrong = cut(_differing(_below(a, wrong, parent), _below(b, wrong, parent), ["archive", "node"]))
    parent = F.floor(F.col("offset") / RANGE_BYTES)
    return _aligned(_below(ours, wrong, parent), _below(theirs, wrong, parent), keep)


def _unmatched(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair the first, second, ... record with equal keys on either side; the pairs, and what each side has left."""
    turn = Window.partitionBy(*keys).orderBy("offset")
    a, b = (x.withColumn("_turn", F.row_number().over(turn)) for x in (ours, theirs))
    match = [*keys, "_turn"]
    pairs = a.select(*match, F.struct(*ours.columns).alias("_ours")).join(
        b.select(*match, F.struct(*theirs.columns).alias("_theirs")), match, "full"
    ).select("_ours", "_theirs")
    both = F.col("_ours").isNotNull() & F.col("_theirs").isNotNull()
    return (
        pairs.filter(both), pairs.filter(F.col("_theirs").isNull()).select("_ours.*"),
        pairs.filter(F.col("_ours").isNull()).select("_theirs.*"),
    )


def _aligned(ours: DataFrame, theirs: DataFrame, keep: list[str]) -> DataFrame:
    """Findings of the ranges that differ.

    Records with equal digests are the same wherever they stand, so a lost or added one shifts the
    rest of its file and no more. What is left lies in gaps between these: there records of one
    length, and then those in the same place, are one that was changed; others are missing or extra.
    """
    same, lost, new = (cut(x) for x in _unmatched(ours, theirs, ["archive", "length", "digest"]))
    # A gap is named by the record in front of it, by its offset in our replica.
    marks = same.select(F.col("_ours.archive").alias("archive"), F.col("_ours.offset").alias("_at"), F.col("_theirs.offset").alias("_there"))

    def in_gaps(rows: DataFrame, place: str) -> DataFrame:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("archive", "offset")]
        posts = marks.select("archive", F.col(place).alias("offset"), *blank, F.col("_at"))
        both = rows.withColumn("_at", F.lit(None).cast("long")).unionByName(posts)
        before = Window.partitionBy("archive").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
        gap = F.coalesce(F.last("_at", True).over(before), F.lit(-1))
        return both.withColumn("_gap", gap).filter(F.col("digest").isNotNull()).drop("_at")

    sized, lost, new = (cut(x) for x in _unmatched(in_gaps(lost, "_at"), in_gaps(new, "_there"), ["archive", "_gap", "length"]))
    placed, lost, new = _unmatched(lost, new, ["archive", "_gap"])
    of = lambda rows, side, status: rows.select(
        *(F.col(f"{side}{c}").alias(c) for c in ("archive", "offset", "length", *keep)), F.lit(status).alias("status")
    )
    changed = of(sized, "_ours.", "differs").unionByName(of(placed, "_ours.", "differs"))
    return changed.unionByName(of(lost, "", "missing")).unionByName(of(new, "", "extra"))
