"""Operators against brute force on small relations."""

import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.operators import depth, flagstat, ordering, records, regions
from readloom.sources import bam, bgzf, store, text
from readloom.streaming import flagstat as stream

REFS = [(0, "a", 100), (1, "b", 40), (2, "empty", 25)]


def reads(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ops = "".join(f"{rng.randint(1, 9)}{rng.choice('MIDNS=X')}" for _ in range(rng.randint(1, 4)))
        flag = sum(b for b in (1, 2, 4, 8, 16, 64, 256, 512, 1024, 2048) if rng.random() < 0.2)
        out.append((i, rng.choice([-1, 0, 0, 1]), rng.choice([-1, rng.randint(0, 99)]), rng.randint(0, 60), flag, rng.randint(-1, 2), f"r{rng.randint(0, 9)}", ops))
    return out


def frame(spark, rows):
    table = spark.createDataFrame(rows, "ordinal long, ref_id int, pos int, mapq int, flag int, next_ref_id int, read_name string, ops string")
    return table.withColumn("cigar", cigar.parse(F.col("ops")))


def refs(spark):
    return spark.createDataFrame(REFS, "ref_id int, name string, length long")


def covered(ops):
    import re

    return sum(int(n) for n, o in re.findall(r"(\d+)([MIDNS=X])", ops) if o in "MDN=X")


@pytest.mark.parametrize("mode", ["exclude", "anchor"])
@pytest.mark.parametrize("bin_size", [7, 1 << 14])
def test_depth_against_counting(spark, mode, bin_size):
    rows = reads(1)
    runs = depth.segments(depth.spans(frame(spark, rows), mode), refs(spark), bin_size).collect()
    base = Counter()
    for _, ref, pos, _, flag, _, _, ops in rows:
        n = covered(ops)
        if n and flag & 1796:  # reads that cover nothing are passed over before the flags are looked at
            n = 1 if mode == "anchor" else 0
        if ref >= 0 and pos >= 0:
            for p in range(pos, min(pos + n, REFS[ref][2])):
                base[REFS[ref][1], p] += 1
    got = {(r["chr"], p): r["depth"] for r in runs for p in range(r["start"], r["end"])}
    assert {k: v for k, v in got.items() if v} == dict(base)
    for _, name, length in REFS:
        mine = sorted((r for r in runs if r["chr"] == name), key=lambda r: r["start"])
        assert mine[0]["start"] == 0 and mine[-1]["end"] == length
        assert all(x["end"] == y["start"] and x["depth"] != y["depth"] for x, y in zip(mine, mine[1:]))


def test_depth_of_nothing_and_regions(spark):
    runs = depth.segments(depth.spans(frame(spark, reads(1)).where("false")), refs(spark))
    assert sorted(map(tuple, runs.select("chr", "start", "end", "depth").collect())) == [("a", 0, 100, 0), ("b", 0, 40, 0), ("empty", 0, 25, 0)]
    cut = spark.createDataFrame([(0, "a", 10, 20), (1, "a", 15, 400), (2, "x", 0, 9), (3, "b", 5, 5), (4, "b", 40, 50)], "region_id int, chr string, start long, end long")
    assert sorted(map(tuple, depth.clip_to_regions(runs, cut, refs(spark), 8).collect())) == [(0, "a", 10, 20, 0), (1, "a", 15, 100, 0)]
    assert sorted(r[0] for r in regions.clip(cut, refs(spark)).collect()) == [0, 1]
    rng = random.Random(5)
    some = [(i, rng.choice("ab"), a, a + rng.randint(0, 60)) for i in range(60) for a in [rng.randint(0, 90)]]
    found = depth.segments(depth.spans(frame(spark, reads(6))), refs(spark))
    wanted = [(i, c, max(r["start"], a), min(r["end"], b), r["depth"]) for i, c, a, b in some for r in found.collect() if r["chr"] == c and max(r["start"], a) < min(r["end"], b)]
    given = spark.createDataFrame(some, "region_id int, chr string, start long, end long")
    for size in (3, 16, 1 << 14):
        assert sorted(map(tuple, depth.clip_to_regions(found, given, refs(spark), size).collect())) == sorted(wanted)


def test_flagstat_is_additive_and_streams(spark, tmp_path):
    table = frame(spark, reads(2)).drop("cigar").withColumn("mapq", F.col("mapq").cast("smallint"))
    whole = flagstat.wide(table).first()
    parts = flagstat.wide(table.where("ordinal < 100")).unionByName(flagstat.wide(table.where("ordinal >= 100")))
    assert flagstat.merge(parts).first() == whole
    assert whole["total_passed"] + whole["total_failed"] == 300
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream.start(stream.read_stream(spark, str(tmp_path / "in"), 1), "totals", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert spark.table("totals").first() == whole
    empty = flagstat.report(table.where("false")).orderBy("line_no").collect()
    assert len(empty) == 16 and empty[6]["line"] == "0 + 0 mapped (N/A : N/A)"


@pytest.mark.parametrize("by", ["coordinate", "name", "name_mates"])
def test_ranks_follow_the_sort(spark, by):
    kind = "array<struct<tag:string,type:string,value:string>>"
    table = frame(spark, reads(3)).withColumn("tags", F.array().cast(kind))
    order = [r["ordinal"] for r in ordering.sort(table, by).collect()]
    ranks = {r["ordinal"]: r["rank"] for r in ordering.ranked(table.repartition(7), by).collect()}
    assert [ranks[o] for o in order] == list(range(300))
    assert ordering.ranked(table.where("false"), by).count() == 0


@pytest.mark.parametrize("by", ["coordinate", "name", "name_mates"])
def test_keys_with_one_beginning_spread_over_tasks(spark, by):
    """Names with one long prefix, and reads without any place."""
    rows = [(i, -1, -1, 0, 4, -1, f"A00123:45:HXXXXXXXX:{(i * 7919) % 4000}", "1M") for i in range(4000)]
    table = frame(spark, rows).withColumn("tags", F.array().cast("array<struct<tag:string,type:string,value:string>>"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share a task
    try:
        ranks = ordering.ranked(table.repartition(4), by, ["ordinal"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=(lambda r: r[0]) if by == "coordinate" else (lambda r: (r[6], r[0])))
    assert [r["ordinal"] for r in ranks.orderBy("rank").collect()] == [r[0] for r in order]
    (folder,) = {f.rsplit("/", 1)[0] for f in ranks.inputFiles()}
    tasks = spark.read.parquet(folder).groupBy(F.shiftright("id", ordering.PLACES)).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 3000


def test_coordinate_order(spark):
    rows = [(0, -1, -1, 0, 0, 0, "x", "1M"), (1, 0, 5, 0, 16, 0, "x", "1M"), (2, 0, 5, 0, 0, 0, "x", "1M"), (3, 0, -1, 0, 0, 0, "x", "1M"), (4, 0, 5, 0, 0, 0, "x", "1M")]
    assert [r["ordinal"] for r in ordering.sort(frame(spark, rows)).collect()] == [3, 2, 4, 1, 0]


def test_patch_dups_only_sets(spark):
    table = frame(spark, reads(4, 20))
    marks = table.select("ordinal", F.when(F.col("ordinal") % 2 == 0, "1").otherwise("x").alias("mark"))
    got = {r["ordinal"]: r["flag"] for r in records.patch_dups(table, marks).collect()}
    assert all(got[r[0]] == (r[4] | 1024 if r[0] % 2 == 0 else r[4]) for r in reads(4, 20))
    for wrong in (marks.where("ordinal > 0"), marks.unionByName(spark.sql("select 99L ordinal, '1' mark"))):
        with pytest.raises(Exception, match="differ in number"):
            records.patch_dups(table, wrong).collect()


def test_templates():
    t = records.Template(["a", "b", "c"]).everything(but=["b"])
    assert t.is_active("a", "c") and not t.is_active("b") and not t.clear().is_active("a")
    with pytest.raises(ValueError):
        t.set("z")


def test_permutation_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.idx")
    index = spark.createDataFrame([(0, 7), (1, 4000000000), (2, 1)], "rank long, ordinal long")
    text.write_permutation(index, path)
    assert open(path, "rb").read() == struct.pack("<3I", 7, 4000000000, 1)
    assert sorted(map(tuple, text.read_permutation(spark, path).collect())) == [(0, 7), (1, 4000000000), (2, 1)]
    many = spark.range(5000).select(F.col("id").alias("rank"), (4999 - F.col("id")).alias("ordinal"))
    text.write_permutation(many, path)
    monkeypatch.setattr(text, "CHUNK", 4 * 700)
    assert sorted(map(tuple, text.read_permutation(spark, path).collect())) == [(i, 4999 - i) for i in range(5000)]
    (tmp_path / "odd").write_bytes(b"12345")
    with pytest.raises(ValueError, match="whole number"):
        text.read_permutation(spark, str(tmp_path / "odd"))


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    path = str(tmp_path / "marks")
    text.write_marks(spark.range(20000).select(F.col("id").alias("ordinal"), (F.col("id") * 31 % 997).cast("string").alias("mark")), path)
    assert open(path).read() == "".join(f"{i * 31 % 997}\n" for i in range(20000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = sorted(map(tuple, text.read_marks(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, str(i * 31 % 997)) for i in range(20000)]


# --- BAM ---------------------------------------------------------------------


def sample_rows(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        seq = "".join(rng.choice("=ACGTN") for _ in range(rng.randint(0, 40)))
        tags = [{"tag": "NM", "type": "C", "value": str(i % 200)}, {"tag": "RG", "type": "Z", "value": "g" * (i % 5)}, {"tag": "XB", "type": "B", "value": "s,1,-2,3"}, {"tag": "XA", "type": "A", "value": "q"}, {"tag": "XF", "type": "f", "value": "1.5"}, {"tag": "HI", "type": "i", "value": str(i)}]
        qual = None if i % 3 == 0 or not seq else bytes(rng.randint(0, 60) for _ in seq)
        rows.append({"ordinal": i, "ref_id": i % 3 - 1, "pos": i if i % 3 else -1, "mapq": i % 256, "bin": 4680, "flag": i % 4096, "next_ref_id": -1, "next_pos": -1, "tlen": -i, "read_name": "n" * (1 + i % 240) + str(i), "cigar": [{"op": "M", "len": 1 + i}] if i % 3 > 1 else [], "seq": seq, "qual": qual, "tags": tags, "tags_raw": None})
    return rows


def test_record_round_trip():
    for row in sample_rows(300):
        raw = bam.encode_record(row)
        back = bam.decode_record(raw[4:])
        assert {k: back[k] for k in back if k != "tags_raw"} == {k: row[k] for k in back if k != "tags_raw"}
        assert bam.encode_record(back | {"ordinal": 0}) == raw


def test_columns_hold_what_records_hold():
    rows = sample_rows(200)
    long_ = sample_rows(3)[2] | {"cigar": [{"op": "M", "len": 1}, {"op": "I", "len": 1}] * 40000, "seq": "A" * 10, "qual": None, "tags": []}
    for given in (rows, [*rows[:20], long_, *rows[20:40]], rows[:1]):
        bodies = [bam.encode_record(r)[4:] for r in given]
        found = bam.decode_records(bodies, set(bam.KINDS))
        assert [dict(zip(found, x)) for x in zip(*[c.to_pylist() for c in found.values()])] == [{k: r[k] for k in found} for r in map(bam.decode_record, bodies)]
        assert {k: c.type for k, c in found.items()} == bam.KINDS
    assert set(bam.decode_records(bodies, {"flag", "seq"})) == {"flag", "seq"}


def test_long_names_raise():
    with pytest.raises(ValueError, match="254"):
        bam.encode_record(sample_rows(1)[0] | {"read_name": "n" * 255})


def test_default_record():
    back = bam.decode_record(struct.pack("<iiBBHHHIiii", -1, -1, 2, 255, 4680, 0, 4, 0, -1, -1, 0) + b"*\0")
    assert (back["read_name"], back["flag"], back["cigar"], back["seq"], back["qual"]) == ("*", 4, [], "", None)


def test_long_cigar_goes_through_its_tag():
    row = sample_rows(3)[2] | {"cigar": [{"op": "M", "len": 1}, {"op": "I", "len": 1}] * 40000, "seq": "A" * 10, "qual": None, "tags": [], "tags_raw": None}
    back = bam.decode_record(bam.encode_record(row)[4:])
    assert back["cigar"] == row["cigar"] and back["tags"] == []


@pytest.mark.parametrize("n, payload, split", [(0, 60000, 1 << 20), (500, 60000, 1 << 20), (3000, 997, 20000), (3000, 200, 5000)])
def test_bam_files_in_runs(spark, tmp_path, n, payload, split):
    rows, refs_ = sample_rows(n), [("a", 1000), ("b", 1000)]
    data = bam.encode_header("@HD\tVN:1.6\n", refs_) + b"".join(map(bam.encode_record, rows))
    blocks = b"".join(bgzf.deflate(data[i : i + payload]) for i in range(0, len(data), payload)) + bgzf.END_BLOCK
    path = tmp_path / "x.bam"
    path.write_bytes(blocks)
    got = bam.read_bam(spark, str(path), split_bytes=str(split)).select("ordinal", "read_name", "flag", "seq").collect()
    assert sorted(map(tuple, got)) == [(r["ordinal"], r["read_name"], r["flag"], r["seq"]) for r in rows]
    assert bam.uncompressed_size(spark, str(path)).first()[1] == len(data)
    assert bam.read_header(str(path))[0] == "@HD\tVN:1.6\n"


def test_damage_is_noticed(spark, tmp_path):
    data = bgzf.compress(bam.encode_header("", [("a", 9)]) + b"".join(map(bam.encode_record, sample_rows(50))))
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="truncated"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()
    with pytest.raises(ValueError, match="not a BGZF"):
        bam.read_header(__file__)


def test_store_round_trip(spark, tmp_path):
    table = frame(spark, reads(5, 50))
    store.write(table, refs(spark), "@HD\n", str(tmp_path / "s"), "brotli", ["ref_id", "pos"])
    rows, names, header = store.read(spark, str(tmp_path / "s"))
    assert rows.exceptAll(table).count() == 0 and rows.count() == 50 and names.count() == 3 and header.first()[0] == "@HD\n"
    some = store.ref_range(rows, 1, 1)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ref_id), GreaterThanOrEqual(ref_id,1), LessThanOrEqual(ref_id,1)]" in plan
    assert some.count() == sum(r[1] == 1 for r in reads(5, 50))
    with pytest.raises(ValueError):
        store.codec("nope")
    with pytest.raises(ValueError):
        ordering.spill_options("tape")


# --- many rows ---------------------------------------------------------------


def test_a_permutation_from_its_file_is_never_broadcast(spark, tmp_path):
    """It has no statistics, so it seems tiny whatever its length."""
    rows, path = frame(spark, reads(7)), str(tmp_path / "x.idx")
    text.write_permutation(ordering.permutation(rows.withColumn("tags", F.array()), "name"), path)
    joined = ordering.gather(rows, text.read_permutation(spark, path))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r["ordinal"] for r in joined.orderBy("rank").collect()] == [r[0] for r in sorted(reads(7), key=lambda r: (r[6], r[0]))]


@pytest.fixture
def many_tasks(spark, monkeypatch):
    """No rows through an iterator that runs one task after another; as many tasks as partitions."""

    def never(*_, **__):
        raise AssertionError("one task at a time")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", never)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


BAM_ROW = "ordinal long, ref_id int, pos int, mapq smallint, bin int, flag int, next_ref_id int, next_pos int, tlen int, read_name string, cigar array<struct<op:string,len:int>>, seq string, qual binary, tags array<struct<tag:string,type:string,value:string>>, tags_raw binary"


def test_all_tasks_encode_a_bam_file_at_once(spark, tmp_path, many_tasks):
    rows, path, refs_ = sample_rows(700), str(tmp_path / "x.bam"), [("a", 1000), ("b", 1000)]
    table = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in BAM_ROW.split(", ")) for r in rows], BAM_ROW).repartition(3)
    bam.write_bam(table, path, "@HD\tVN:1.6\n", refs_)
    whole = bam.encode_header("@HD\tVN:1.6\n", refs_) + b"".join(map(bam.encode_record, rows))
    assert b"".join(bam.view_bytes(table, "@HD\tVN:1.6\n", refs_)) == whole
    assert bam.header_text(spark, path).first()[0] == "@HD\tVN:1.6\n" and [tuple(r)[1:] for r in bam.ref_seqs(spark, path).collect()] == refs_
    assert bam.uncompressed_size(spark, path).first()[1] == len(whole)
    with open(path, "rb") as file:
        assert bam._Inflated(file).take(len(whole) + 1) == whole and open(path, "rb").read().endswith(bgzf.END_BLOCK)
    assert sorted(map(tuple, bam.read_bam(spark, path, fields="flag,pos,read_name").select("ordinal", "flag", "pos", "read_name").collect())) == [(r["ordinal"], r["flag"], r["pos"], r["read_name"]) for r in rows]
    bam.write_bam(table.where("false"), path, "", refs_)
    assert bam.read_bam(spark, path).count() == 0


def test_all_tasks_encode_other_files_at_once(spark, tmp_path, many_tasks):
    path = str(tmp_path / "x")
    text.write_permutation(spark.range(5000).select(F.col("id").alias("rank"), (4999 - F.col("id")).alias("ordinal")), path)
    assert open(path, "rb").read() == struct.pack("<5000I", *range(4999, -1, -1))
    text.write_marks(spark.range(5000).select(F.col("id").alias("ordinal"), (F.col("id") % 7).cast("string").alias("mark")), path)
    assert open(path).read() == "".join(f"{i % 7}\n" for i in range(5000))
    runs = spark.range(5000).select(F.lit("a").alias("chr"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.lit(2).alias("depth"))
    depth.write_bed_gz(runs.orderBy("start"), path)
    import gzip

    assert gzip.open(path, "rt").read() == "".join(f"a\t{i}\t{i + 1}\t2\n" for i in range(5000))


def test_short_runs_share_tasks(spark, tmp_path, monkeypatch):
    rows, path = sample_rows(3000), tmp_path / "x.bam"
    data = bam.encode_header("", [("a", 1000), ("b", 1000)]) + b"".join(map(bam.encode_record, rows))
    path.write_bytes(b"".join(bgzf.deflate(data[i : i + 400]) for i in range(0, len(data), 400)) + bgzf.END_BLOCK)
    options = {"path": str(path), "split_bytes": "2000"}
    runs = [r for t in bam.BamReader(options).partitions() for r in t.runs]
    monkeypatch.setattr(bam, "TASKS", 5)
    tasks = bam.BamReader(options).partitions()
    assert len(tasks) <= 10 and max(len(t.runs) for t in tasks) > 9 and [r for t in tasks for r in t.runs] == runs and len(runs) > 100
    got = bam.read_bam(spark, str(path), split_bytes="2000").select("ordinal", "read_name", "flag", "seq").collect()
    assert sorted(map(tuple, got)) == [(r["ordinal"], r["read_name"], r["flag"], r["seq"]) for r in rows]


def test_columns_are_encoded_as_records_are(monkeypatch):
    import pyarrow as pa

    rng, kinds = random.Random(8), pa.schema([("ordinal", pa.int64()), *bam.KINDS.items()])
    plain = [r | {"tags": [t for t in r["tags"] if t["type"] in "ZiC"]} for r in sample_rows(200)]
    gaps = [r | {"read_name": rng.choice([None, "", "x"]), "seq": rng.choice([None, "", "acgtxE9=*"]), "tags": rng.choice([None, [], r["tags"]]), "cigar": rng.choice([None, [], [{"op": "X", "len": (1 << 28) - 1}] * 2]), "qual": rng.choice([None, b"", b"\1\xff"])} for r in plain]
    long_ = sample_rows(3)[2] | {"cigar": [{"op": "M", "len": 1}] * 70000, "seq": "AC", "qual": None, "tags": []}
    raw = [r | {"tags_raw": b"NMC\xff" * rng.randint(0, 3)} for r in gaps]
    for at_once in (bam.ENCODED, 3000):
        monkeypatch.setattr(bam, "ENCODED", at_once)
        for rows in (plain, gaps, raw, [*raw, *gaps], sample_rows(50), [plain[0], long_, plain[1]], [plain[0] | {"read_name": "\xe9"}], []):
            parts = list(bam.encode_records(pa.RecordBatch.from_pylist(rows, schema=kinds)))
            assert [x for _, y in parts for x in y.to_pylist()] == [bam.encode_record(r) for r in rows]
            assert [x for p, _ in parts for x in p.column("ordinal").to_pylist()] == [r["ordinal"] for r in rows]
    for wrong in ({"tags": [{"tag": "NM", "type": "C", "value": "256"}]}, {"mapq": -1}, {"pos": None}, {"read_name": "n" * 255}, {"cigar": [{"op": "Q", "len": 1}]}):
        with pytest.raises((ValueError, struct.error)):
            list(bam.encode_records(pa.RecordBatch.from_pylist([plain[0] | wrong], schema=kinds)))
