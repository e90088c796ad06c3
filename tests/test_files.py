"""Files by byte ranges against whole files, and path expansion."""

import os
import random
import re

import pytest

from tracewright.config import Parse
from tracewright.operators.records import cut_records, parse_lines
from tracewright.sources.files import expand, from_files, from_text

WORDS = ["10:00:00 INFO a.B - x", "more", "", "привет", '{"message":"m","level":"warn"}', "GET /x HTTP/1.1", "Host: h", "\tat a.B.c(B.java:1)", "java.lang.Error: bad", "x" * 90, "ਊ Ċ Ā", "਀\u000b"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of some dozen bytes, so that they end inside records, characters and line ends."""
    conf = {"spark.sql.files.maxPartitionBytes": "173b", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def made(seed, words, last=""):
    rnd = random.Random(seed)
    return "".join(rnd.choice(words) + rnd.choice(["\n", "\r\n", "\r\n", "\r", "\n"]) for _ in range(40)) + last


def expected(text):
    parts = re.split(r"\r\n|\r|\n", text.removeprefix("﻿"))
    return parts[:-1] if parts[-1] == "" else parts


@pytest.mark.parametrize("charset", ["UTF-8", "cp1251", "utf-16", "utf-16-le", "utf-16-be", "utf-32"])
def test_ranges_give_the_lines_of_whole_files(spark, tmp_path, small_ranges, charset):
    words = [w for w in WORDS if charset != "cp1251" or w.isascii() or w == "привет"]
    texts = {"a b+c%.log": made(1, words), "b.log": made(2, words, "no line end"), "c.log": ("﻿" if charset == "UTF-8" else "") + made(3, words), "[d].log": "one", "e.log": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode(charset))
    paths = [str(tmp_path / n) for n in texts]
    lines, warnings = from_files(spark, paths, charset)
    got = {}
    for r in lines.orderBy("file_ord", "line_no").collect():
        got.setdefault(r["file_ord"], []).append((r["line_no"], r["line"]))
    want = {i: list(enumerate(expected(t), 1)) for i, t in enumerate(texts.values()) if t}
    assert got == want
    assert lines.select("source_file").distinct().count() == 4
    assert [(os.path.basename(r[0]), r[1]) for r in warnings.collect()] == [("e.log", "empty file")]


def test_broken_files_give_a_warning(spark, tmp_path, small_ranges):
    for name, data in {"a.log": made(5, WORDS).encode() + b"\xff\n", "b.log": made(6, WORDS).encode(), "c.log": "x".encode("utf-16-le") * 50 + b"\n\0" + b"\x00\xd8" * 3}.items():
        (tmp_path / name).write_bytes(data)
    of = lambda names, charset: [{os.path.basename(r["source_file"]) for r in d.select("source_file").distinct().collect()} for d in from_files(spark, [str(tmp_path / n) for n in names], charset)]
    assert of(["a.log", "b.log"], "UTF-8") == [{"b.log"}, {"a.log"}]
    assert of(["c.log"], "utf-16-le") == [set(), {"c.log"}]
    with pytest.raises(ValueError):
        from_files(spark, [str(tmp_path / "a.log")], "utf-7")


def test_records_over_ranges(spark, tmp_path, small_ranges):
    text = made(9, WORDS[:10]).replace("\r\n", "\n").replace("\r", "\n")
    (tmp_path / "a.log").write_text(text)
    lines, _ = from_files(spark, [str(tmp_path / "a.log")])
    day = Parse(default_date="2026-01-01")
    columns = ["seq", "ts", "level", "message", "exception", "http", "kind", "attributes", "raw"]
    got = parse_lines(lines, Parse(default_date="2026-01-01", block_lines=3)).select(*columns).orderBy("seq").collect()
    assert got == parse_lines(from_text(spark, text), day).select(*columns).orderBy("seq").collect() and len(got) > 5


@pytest.mark.parametrize("text,most,warned", [("a\nb\n10:00:00 INFO a.B - x\n", 2, True), ("10:00:00 INFO a.B - x\n10:00:01 INFO a.B - y\nmore\n", 2, False), ("10:00:00 INFO a.B - x\n10:00:01 INFO a.B - y\n10:00:02 INFO a.B - z\n", 2, True)])
def test_limit_of_events(spark, text, most, warned):
    for block in (0, 1):
        parse = Parse(default_date="2026-01-01", max_events=most, block_lines=block)
        assert parse_lines(from_text(spark, text), parse).count() == most
        found = [r["warning"] for r in cut_records(from_text(spark, text), parse).collect()]
        assert found == (["the limit of 2 events is reached, later lines are left out"] if warned else [])


def test_expansion(spark, tmp_path):
    for name in ("a.log", "b+ c.txt", "d.md", "e.log.1", "sub/f.log", "sub/k=v/g.json", "day=1/h.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    short = lambda *given, **more: [os.path.relpath(p, tmp_path) for p in expand([str(tmp_path / g) for g in given], spark=spark, **more)]
    (tmp_path / "sub" / "empty.log").touch()
    (tmp_path / "b+ c.txt").write_text("")
    assert short("") == ["a.log", "b+ c.txt", "e.log.1"]
    assert short("", recursive=True) == ["a.log", "b+ c.txt", "day=1/h.log", "e.log.1", "sub/empty.log", "sub/f.log", "sub/k=v/g.json"]
    assert short("", masks=("*.md",)) == ["d.md"]
    assert short("*.log", "sub/f.log", "a.log", "none*.log") == ["a.log", "sub/f.log"]
    with pytest.raises(FileNotFoundError):
        short("missing.log")


def test_other_file_systems(spark, tmp_path):
    """A scheme that no local call can open."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("10:00:00 INFO a.B - x\n")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}/in")
    paths = expand(["viewfs://logs/in"], spark=spark)
    assert paths == ["viewfs://logs/in/a.log"]
    lines, warnings = from_files(spark, paths)
    assert [(r["source_file"], r["line"]) for r in lines.collect()] == [("viewfs://logs/in/a.log", "10:00:00 INFO a.B - x")] and not warnings.count()
    with pytest.raises(FileNotFoundError):
        expand(["viewfs://logs/in/none.log"], spark=spark)
