"""CSV files read in splits against the parser of whole files."""

import random

import pytest
from corpus_jobs.sources import csv_files, files


def made(rng, n, end="\n"):
    def cell():
        c = rng.choice(["", "NA", "plain", "two words", " padded ", "5\" pipe", "x\ry", "ünï", "12.5"])
        if rng.random() < 0.25:
            c = '"' + rng.choice(["a,b", "line one\nline two", 'said ""so""', "\n\n", "tail\n", "", 'x"" \n ""y']) + '"' + rng.choice(["", "", "z"])
        return c

    return end.join(",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4, 1]))) for _ in range(n))


def in_one_task(spark, folder):
    found = files.csv_sections(files.read_files(spark, folder)).select("file_path", "section_index", "text", "columns", "row_range")
    return sorted((r[0].split("/")[-1], *r[1:]) for r in found.collect())


def in_splits(spark, folder, piece):
    found = csv_files.sections(spark, f"{folder}/*", piece=piece).select("file_path", "section_index", "text", "columns", "row_range")
    return sorted((r[0].split("/")[-1], *r[1:]) for r in found.collect())


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "4"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_splits_give_the_sections_of_the_whole(spark, tmp_path, small_splits, piece):
    """Quoted line feeds over splits and pieces, quotes within fields, files of several shapes and encodings."""
    rng = random.Random(piece)
    (tmp_path / "big.csv").write_text("id,name,\"what, and\nwhere\"\n" + made(rng, 900), newline="", encoding="utf-8")
    (tmp_path / "windows.csv").write_text("a,b,c\r\n" + made(rng, 60, "\r\n"), newline="", encoding="utf-8-sig")
    (tmp_path / "latin.csv").write_bytes(("a,b,c\n" + made(rng, 300)).encode("latin-1"))
    (tmp_path / "old.csv").write_bytes(b'a,b\r1,2\r"3\r4",5\r')
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"never closed\nstill\n')
    (tmp_path / "long.csv").write_bytes(b'a,b\n1,"' + b"word \n" * 3000 + b'"\n2,3\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"a,b\n")
    (tmp_path / "blank.csv").write_bytes(b"\n1,2\n")
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 3
    want = in_one_task(spark, str(tmp_path))
    assert {w[0] for w in want} == {"big.csv", "windows.csv", "latin.csv", "old.csv", "open.csv", "long.csv"}
    assert in_splits(spark, str(tmp_path), piece) == want


def test_line_states():
    rng = random.Random(2)

    def plain(line, quoted):
        """The reader's states, one character after the other."""
        state = "in" if quoted else "start"
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c in ",\r" else "field"
            elif state == "field":
                state = "start" if c in ",\r" else "field"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            else:
                state = "in" if c == '"' else "start" if c in ",\r" else "field"
        return state == "in"

    for _ in range(5000):
        line = "".join(rng.choice('a,"\r') for _ in range(rng.randrange(12)))
        for quoted in (False, True):
            assert csv_files.ends_quoted(line.encode(), quoted) == plain(line, quoted), (line, quoted)
