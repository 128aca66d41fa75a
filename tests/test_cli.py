"""The command line on a small file."""

import gzip

import pytest

from readloom import cli
from readloom.sources import bam, bgzf

from .test_operators import sample_rows


@pytest.fixture
def source(tmp_path):
    rows = [r | {"ref_id": 1 - i % 2, "pos": 5 * i, "flag": 0, "mapq": 60, "cigar": [{"op": "M", "len": 10}]} for i, r in enumerate(sample_rows(12))]
    data = bam.encode_header("@HD\tVN:1.6\n", [("z", 100), ("b", 100)]) + b"".join(map(bam.encode_record, rows))
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf.compress(data))
    return str(path), data, rows


def test_verbs(spark, source, tmp_path, capfdbinary):
    path, data, rows = source
    store, index, bed = str(tmp_path / "store"), str(tmp_path / "i"), str(tmp_path / "d.bed.gz")
    cli.main(["convert", path, store, "--codec", "zstd", "--sort-temp-mode", "lz4_ram"])
    for verb in (["uncompressed-size", path], ["flagstat", store], ["header", store], ["test", store]):
        cli.main(verb)
    said = capfdbinary.readouterr().out.decode()
    assert said.startswith(f"{len(data)}\n12 + 0 in total") and "@HD" in said and "Covered bases: 120" in said
    cli.main(["view", store])
    assert capfdbinary.readouterr().out == data
    cli.main(["depth", store, "--out", bed])
    lines = [x.split("\t") for x in gzip.open(bed, "rt").read().splitlines()]
    assert [x[0] for x in lines] == sorted((x[0] for x in lines), reverse=True)  # header order: z before b
    assert sum((int(b) - int(a)) * int(d) for _, a, b, d in lines) == 120
    cli.main(["depth", store, "--query", "b:0-20", "--query", "z 5 25"])
    said = [x.split("\t") for x in capfdbinary.readouterr().out.decode().splitlines()]
    assert {x[0] for x in said} == {"z", "b"} and all(0 <= int(x[1]) < 25 for x in said) and said[0][0] == "z"
    (tmp_path / "marks").write_text("1\n" * 12)
    cli.main(["patch", store, str(tmp_path / "patched"), str(tmp_path / "marks")])
    cli.main(["flagstat", str(tmp_path / "patched")])
    assert "12 + 0 duplicates" in capfdbinary.readouterr().out.decode()


def test_regions_are_numbered_apart(spark, tmp_path):
    (tmp_path / "x.bed").write_text("a 1 5\nb 2 9\nc 0 3\n")
    found = cli._regions(spark, str(tmp_path / "x.bed"), ["b:4-6", "d 1 2"]).collect()
    assert sorted((r["region_id"], r["chr"], r["start"], r["end"]) for r in found) == [(0, "b", 4, 6), (1, "d", 1, 2), (2, "a", 1, 5), (4, "c", 0, 3)]


def test_spill_settings_reach_a_new_session(monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def session(options):
        seen.update(options)
        raise Stop

    monkeypatch.setattr(cli, "_session", session)
    with pytest.raises(Stop):
        cli.main(["convert", "a", "b", "--sort-temp-mode", "lz4_file"])
    assert seen == {"spark.shuffle.spill.compress": "true", "spark.io.compression.codec": "lz4"}
