"""Stored catalogues: snapshots, links beside the records, batches; numbering; the order of linking; reports and local files."""

import gzip
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.operators import catalogue as G
from quillspark.operators import expand as E
from quillspark.operators import ingest as I
from quillspark.operators import linking as K
from quillspark.operators import naming as N
from quillspark.operators import reports as P
from quillspark.operators import search as Q
from quillspark.schema import RECORD_CODES, RECORDS
from quillspark.sources import files as L
from quillspark.sources import shards as S
from quillspark.streaming import ingest as stream


def records(spark, rids, title="some words"):
    of = lambda rid, f: {"rid": rid, "aa_id": f"a{rid}", "title": f"{title} {rid}", "md5": f"{rid:032x}"}.get(f.name)
    return spark.createDataFrame([tuple(of(rid, f) for f in RECORDS.fields) for rid in rids], RECORDS)


def codes(spark, rids):
    return spark.createDataFrame([(rid, "md5", f"{rid:032x}") for rid in rids], RECORD_CODES)


def make(spark, target, rids, replace=False, title="some words"):
    return G.written(spark, target, G.base(spark, target, replace), lambda folder: G.write_tables(records(spark, rids, title), codes(spark, rids), target, folder))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_snapshots(spark, tmp_path):
    target = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        G.opened(spark, target)
    make(spark, target, range(1, 6))
    reader = G.opened(spark, target)
    with pytest.raises(FileExistsError):
        make(spark, target, [9])
    make(spark, target, [7, 8], replace=True)
    assert G.vacuum(spark, target) == []  # nothing is old enough
    assert reader.records.count() == 5 and Q.keyword_count(reader.records, "words", built=reader.index).head().hits == 5
    assert {r.rid for r in G.opened(spark, target).records.collect()} == {7, 8}
    # two writers that began at one snapshot
    since = G.current(spark, target)
    G.commit(spark, target, since, since)
    before = set(os.listdir(target))
    with pytest.raises(G.Conflict):
        G.written(spark, target, since, lambda folder: G.write_tables(records(spark, [1]), codes(spark, [1]), target, folder))
    assert set(os.listdir(target)) == before
    gone = G.vacuum(spark, target, keep=0, now=4e9)
    assert len(gone) == 3 and G.opened(spark, target).records.count() == 2
    G.empty_catalogue(spark, target, replace=True)
    assert G.opened(spark, target).records.count() == 0
    with pytest.raises(ValueError, match="not unique"):
        make(spark, target, [1, 1], replace=True)


def test_links_are_written_beside_the_records(spark, tmp_path, monkeypatch):
    target, n = str(tmp_path / "c"), 3000
    make(spark, target, range(n))
    reader, whole = G.opened(spark, target), size(target)
    link = lambda *pairs: G.apply_links(spark, target, spark.createDataFrame(pairs, "rid long, path string"))
    link((5, "/x/5"), (6, "/x/6"))
    assert size(target) - whole < 0.1 * whole
    link((6, "/y/6"))
    paths = lambda: {r.rid: r.local_path for r in G.opened(spark, target).records.where("local_path is not null").collect()}
    assert paths() == {5: "/x/5", 6: "/y/6"} and reader.records.where("local_path is not null").isEmpty()
    monkeypatch.setattr(G, "MOST_LINKS", 2)
    link((7, "/z/7"), (5, "/z/5"))
    assert len(G.current(spark, target).links) == 1 and paths() == {5: "/z/5", 6: "/y/6", 7: "/z/7"}
    G.compact(spark, target)
    assert G.current(spark, target).links == () and paths() == {5: "/z/5", 6: "/y/6", 7: "/z/7"} and G.opened(spark, target).records.count() == n
    # the run as a whole, twice: the second finds the record taken
    files = spark.createDataFrame([(f"/f/{12:032x}.pdf", None, None), ("/f/no.txt", None, "gone")], "path string, content_md5 string, error string")
    for wanted in ("linked", "unmatched"):
        entries, stats = K.link(spark, files, G.opened(spark, target), target)
        rows = {r.path: r for r in entries.collect()}
        assert rows[f"/f/{12:032x}.pdf"].status == wanted and rows["/f/no.txt"].status == "unreadable" and rows["/f/no.txt"].error == "gone"
        assert stats["files"] == 2 and stats["unreadable"] == 1
    assert paths()[12] == f"/f/{12:032x}.pdf"


def shard(folder, number, ids, zipped=True, bad=None):
    lines = [json.dumps({"_source": {"id": f"d{i}", "search_only_fields": {"search_title": f"title {i}"}, "file_unified_data": {"identifiers_unified": {"md5": [f"{i:032x}"]}}}}) for i in ids]
    text = "\n\n".join(lines + ([bad] if bad else [])) + "\n"
    with (gzip.open(folder / f"aarecords__{number}.json.gz", "wt") if zipped else open(folder / f"{number}.json", "w")) as f:
        f.write(text)


def test_numbering_moves_no_document(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for number, ids in ((10, range(30, 40)), (2, range(10, 30)), (1, range(10))):
        shard(src, number, ids)
    rows = S.read_lines(spark, S.discover(spark, str(src)))
    rows.write.parquet(str(tmp_path / "lines"))
    stored = spark.read.schema(S.LINES).parquet(str(tmp_path / "lines"))
    numbered = S.numbered(stored)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan
    assert [r.i for r in numbered.select("rid", F.get_json_object("value", "$._source.id").alias("i")).orderBy("rid").collect()] == [f"d{i}" for i in range(40)]
    made = I.build(spark, str(src), str(tmp_path / "out"))
    assert made["parsed"] == {"lines": 77, "blank": 37, "records": 40, "codes": 40} and [s["lines"] for s in made["shards"]] == [10, 20, 10]


def test_limits_read_only_the_shards_they_need(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for number in range(5):
        shard(src, number, range(10 * number, 10 * number + 10))
    (src / "aarecords__9.json.gz").write_bytes(b"no gzip at all")  # a shard that nobody may read
    paths = S.discover(spark, str(src))
    ids = lambda df: [r.i for r in df.select("shard", "at", F.get_json_object("value", "$._source.id").alias("i")).orderBy("shard", "at").collect()]
    assert ids(S.limited(spark, paths, 25, False, str(tmp_path / "a"))) == [f"d{i}" for i in range(25)]
    assert ids(S.limited(spark, paths[:5], 7, True, str(tmp_path / "b"))) == ["d0", "d1", "d10", "d11", "d20", "d30", "d40"]
    assert ids(S.limited(spark, paths[:5], 500, False, str(tmp_path / "c"))) == [f"d{i}" for i in range(50)]
    made = I.build(spark, str(src), str(tmp_path / "out"), limit=12)
    assert made["records"] == 12 and G.opened(spark, str(tmp_path / "out")).records.agg(F.max("rid")).head()[0] == 12


def test_a_bad_line_of_a_file_in_many_splits(spark, tmp_path):
    shard(tmp_path, 1, range(400), zipped=False, bad="{bad")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path / "1.json")).rdd.getNumPartitions() > 4
        assert S.first_bad_line(spark, str(tmp_path / "1.json")) == 801
        with pytest.raises(ValueError, match="1.json, line 801: not JSON"):
            I.build(spark, str(tmp_path / "1.json"), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_streamed_batches_equal_a_build(spark, tmp_path):
    src, target = tmp_path / "in", str(tmp_path / "c")
    src.mkdir()
    words = lambda c: sorted(map(tuple, c.index[0].select("term", "rid", "col", "pos").collect()))
    for n in range(3):
        shard(src, n, range(5 * n, 5 * n + 5))
        stream.start(spark, str(src), target, str(tmp_path / "check")).awaitTermination()
    got = G.opened(spark, target)
    I.build(spark, str(src), str(tmp_path / "whole"))
    whole = G.opened(spark, str(tmp_path / "whole"))
    assert len(G.current(spark, target).index) == 4  # an empty catalogue and three batches
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(got.records.select("rid", "aa_id", "title"), whole.records.select("rid", "aa_id", "title")) and same(got.codes, whole.codes)
    assert words(got) == words(whole) and same(got.index[2], whole.index[2])
    assert same(Q.scored(*got.index, "title 7"), Q.scored(*whole.index, "title 7"))
    G.compact(spark, target)
    assert len(G.current(spark, target).index) == 1 and words(G.opened(spark, target)) == words(whole)
    # a batch that runs again changes nothing
    number = G.current(spark, target).number
    G.append(spark, target, lambda last: 1 / 0, str(tmp_path / "check"), 2)
    assert G.current(spark, target).number == number
    shard(src, 7, [3])
    with pytest.raises(Exception, match="not unique"):
        stream.start(spark, str(src), target, str(tmp_path / "check")).awaitTermination()


def settled_slowly(rows):
    """Files in order of their paths: the first value of the first stage that still has a record."""
    gone, out = set(), {}
    for path, mine in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        for (stage, _), some in itertools.groupby(mine, key=lambda r: (r[1], r[2])):
            left = sorted((r for r in some if r[4] not in gone), key=lambda r: r[5])
            rids = sorted(r[4] for r in left)[:3] if stage < 4 else sorted(r[4] for r in left[: K.TITLE_TOP] if r[6])
            if rids:
                out[path] = (stage, rids)
                if len(rids) == 1:
                    gone.add(rids[0])
                break
    return out


@pytest.mark.parametrize("guesses, crowd, files", [(6, 1000, 50), (1, 1000, 16), (1, 2, 10)])
def test_links_in_order(spark, guesses, crowd, files):
    r = random.Random(guesses + crowd)
    schema = "path string, stage int, ord int, value string, rid long, place int, accepted boolean"
    for world in range(2):
        rows = []
        for n in range(files):
            for stage in sorted(r.sample(range(5), r.choice([1, 1, 2, 3]))):
                for place, rid in enumerate(r.sample(range(14 + 14 * world), r.choice([1, 1, 2, 2, 11]) if stage == 4 else r.choice([1, 1, 1, 2]))):
                    rows.append((f"f{n:03d}", stage, 0, "v", rid, place if stage == 4 else 0, stage < 4 or r.random() < 0.6))
        got = {x.path: (x.stage, x.rids) for x in K.in_order(spark.createDataFrame(rows, schema), guesses, crowd).collect()}
        assert got == settled_slowly(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each file wants the record that the one before falls back on."""
    n, kept, store = 5_000, [], K.stored
    monkeypatch.setattr(K, "stored", lambda df: kept.append(1) or store(df))
    ids = spark.range(n).select(F.format_string("f%07d", "id").alias("path"), F.explode(F.array(F.struct(F.lit(0).alias("stage"), (F.col("id") - 1).alias("rid")), F.struct(F.lit(1).alias("stage"), F.col("id").alias("rid")))).alias("x"))
    rows = ids.select("path", "x.stage", F.lit(0).alias("ord"), F.lit("v").alias("value"), "x.rid", F.lit(0).alias("place"), F.lit(True).alias("accepted")).where("rid >= 0 and not (path = 'f0000000' and stage = 0)")
    out = K.in_order(rows, guesses=2)
    assert out.where("rids[0] = cast(substring(path, 2) as bigint) and size(rids) = 1").count() == n
    assert len(kept) < 40


def test_candidates_are_counted_together(spark, monkeypatch):
    rows, calls, count = records(spark, range(30)), [], Q.keyword_counts
    monkeypatch.setattr(Q, "keyword_counts", lambda *a, **k: calls.append(a[1]) or count(*a, **k))
    monkeypatch.setattr(E, "broad_limit", lambda hits: 5 * hits)
    asked = [{"text": t} for t in ("words 4", "some", "Words 3", "zz", "a/b", "words  3", "some 5", "")]
    accepted, rejected = E.validated(rows, "words 3", asked, Q.Filters())
    assert calls == [["words 3", "words 4", "some", "zz", "some 5"]] and [(a["text"], a["corpus_hits"]) for a in accepted] == [("words 4", 1), ("some 5", 1)]
    assert [r["reason"] for r in rejected] == ["30 hits, too many", "literal", "no hits", "identifier or path", "literal", "blank"]
    assert [r.hits for r in count(rows, ["some", "--", "words 3", "7"], Q.Filters()).orderBy("query").collect()] == [30, 0, 1, 1]


def test_cache_counts_uses(spark, tmp_path):
    times = iter(f"t{n}" for n in range(20))
    cache, other = (E.Cache(spark, str(tmp_path / "x"), now=lambda: next(times)) for _ in range(2))
    flags = dict.fromkeys(E.FLAGS, "1")
    cache.put("q", flags, [], [{"text": "a"}])
    assert other.get("q", flags) == [{"text": "a"}] and other.get("q", flags | {"model_name": "2"}) is None and other.get("z", flags) is None
    other.put("r", flags, [], [])
    cache.put("q", flags, [], [{"text": "b"}])
    seen = lambda: {r.query_norm: (r.created_at, r.last_used_at, r.use_count) for r in cache.rows().collect()}
    assert seen() == {"q": ("t0", "t3", 3), "r": ("t2", "t2", 1)} and cache.get("q", flags) == [{"text": "b"}]
    before = seen()
    cache.compact()
    assert seen() == before and len(os.listdir(tmp_path / "x" / "v1")) == 1


def test_expansion_fails_open_and_asks_a_program(spark, tmp_path):
    rows = records(spark, range(3))
    program = E.ProcessProvider(["sh", "-c", """echo 'well: {"expansions": [{"text": "words 2"}]} so'"""])
    found, said = E.expanded_search(rows, "nothing here", Q.Filters(), program)
    assert [r.rid for r in found.collect()] == [2] and said["attempted"] and said["provider"] == "process"
    assert "taken: words 2 (1 hits)" in P.expansion_text(said)
    found, said = E.expanded_search(rows, "nothing here", Q.Filters(), E.ProcessProvider(["false"]))
    assert found.isEmpty() and said["skipped"].startswith("failed")


def test_local_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    (root / "b" / ".c").mkdir(parents=True)
    for name, text in (("b.txt", "hello"), ("b/a", ""), ("b/.c/_z", "x"), (".h", "y"), ("b-1", "w"), ("t/", None)):
        (root / name).mkdir() if text is None else (root / name).write_text(text)
    os.symlink(root / "b.txt", root / "link")
    os.symlink(root / "b", root / "around")
    names = [p.removeprefix(f"{root}/") for p, _, _ in L.walked(spark, str(root))]
    assert names == [".h", "b/.c/_z", "b/a", "b-1", "b.txt"] and len(L.walked(spark, str(root), 2)) == 2
    found = L.walked(spark, str(root))
    monkeypatch.setattr(L, "walked", lambda *a: [*found, (f"{root}/lost", 1, True), (f"{root}/.lost", 1, False)])
    got = {r.path.removeprefix(f"{root}/"): (r.content_md5, r.error) for r in L.local_files(spark, str(root), contents=True).collect()}
    assert got["b.txt"] == ("5d41402abc4b2a76b9719d911017c592", None) and got["b/a"][0] == "d41d8cd98f00b204e9800998ecf8427e" and got["b/.c/_z"][0] == "9dd4e461268c8034f5c8564e155c67a6"
    assert got["lost"] == (None, "unreadable") and got[".lost"][0] is None and got[".lost"][1]
    with pytest.raises(FileNotFoundError):
        monkeypatch.undo()
        L.local_files(spark, str(tmp_path / "none"))


def test_reports(spark, tmp_path):
    rows = records(spark, range(4)).withColumn("original_filename", F.when(F.col("rid") < 2, F.lit("same.pdf")))
    files = spark.createDataFrame([("/f/SAME.pdf", None), (f"/f/{3:032x}", None), ("/f/any", f"{2:032x}"), ("/f/some words 3.txt", None), ("/f/q", None)], "path string, content_md5 string")
    found = K.features(files)
    outcomes = K.link_independent(found, rows, codes(spark, range(4)))
    stats, entries = K.statistics(outcomes).head().asDict() | {"hashed": 1}, K.entries(outcomes, found, rows, dry_run=True)
    said = json.loads(P.link_report(stats, entries, True))
    by = {e["path"]: e for e in said["entries"]}
    assert said["kind"] == "link_local_report" and said["stats"]["files_hashed_md5"] == 1 and said["stats"]["linked_by_md5"] == 2
    assert [c["aa_id"] for c in by["/f/SAME.pdf"]["ambiguity"]["candidates"]] == ["a0", "a1"] and "matched" not in by["/f/SAME.pdf"]
    assert by["/f/any"]["matched"]["evidence"] == {"kind": "md5", "value": f"{2:032x}", "used_content_md5": True, "summary": f"by md5 {2:032x} of the contents"} and by["/f/any"]["status"] == "would_link"
    assert by["/f/any"]["matched"]["record"] == {"aa_id": "a2", "title": "some words 2"} and by["/f/q"] == {"path": "/f/q", "file_name": "q", "identifiers": by["/f/q"]["identifiers"], "status": "unmatched"}
    P.write_link_report(stats, entries, True, str(tmp_path / "r"))
    written = {r.path: r for r in spark.read.json(str(tmp_path / "r" / "entries")).collect()}
    assert json.load(open(tmp_path / "r" / "report.json"))["stats"]["ambiguous"] == 2 and written["/f/SAME.pdf"].ambiguity.candidates[1].aa_id == "a1"
    page = P.rows_of(Q.results(Q.keyword(rows, "words 3")), ("aa_id", "title", "author", "year", "language", "extension", "bm25_score"))
    assert json.loads(P.search_report("keyword", "words 3", Q.Filters(), page))["result_count"] == 1 and "some words 3" in P.search_text(page) and P.search_text([]) == "nothing found"
    assert json.loads(P.error_report(ValueError("no")))["error"] == "no" and "ambiguous: 2" in P.link_text(stats)
    down = json.loads(P.download_report("md5", "x", {"aa_id": "a", "md5": None, "title": None}, {"output_dir": "/d", "output_name": None}, "/d/a.bin", {"status": "already_present"}))
    assert down["record"] == {"aa_id": "a", "md5": ""} and down["outcome"]["status"] == "already_present" and down["request"] == {"selector": {"mode": "md5", "value": "x"}, "output_dir": "/d"}
    assert json.loads(P.config_report("/c", False, config.resolved({}, {}, {"HOME": "/h"})))["values"]["downloads"] == {"value": "/h/Downloads", "source": "default"}
    assert json.loads(P.config_path_report("/c", True))["exists"] and json.loads(P.config_init_report("/c", False))["created"]
    with pytest.raises(ValueError):
        P.report("other")


def test_destinations(spark):
    rows = records(spark, [1]).withColumns({"extension": F.lit(" "), "original_filename": F.lit(" ")})
    of = lambda *a: rows.select(N.destination(*a)).head()[0]
    assert of("/d/", "aa_id") == "/d/a1.bin" and of("/d", "flat", " x/y ") == "/d/x_y"
    for given in (("/d", "original"), ("/d", "flat", "  ")):
        with pytest.raises(Exception, match="no file name"):
            of(*given)
    there = spark.createDataFrame([(False, False, False), (True, True, False), (True, False, True), (True, False, False)], "e boolean, m boolean, r boolean")
    assert [r[0] for r in there.select(N.existing_file(F.col("e"), F.col("m"), F.col("r"))).collect()] == ["download", "already_present", "download", "error"]
    assert spark.range(1).select(N.same_md5(F.lit("aB"), F.lit("Ab"))).head()[0]


def test_modes_and_lines():
    assert Q.one_mode(keyword="x") == ("keyword", "x") and Q.one_mode(isbn="1") == ("isbn", "1")
    for given in ({}, {"keyword": "x", "doi": "1"}):
        with pytest.raises(ValueError):
            Q.one_mode(**given)
    assert S.parse_line(" \t") is None and S.parse_line('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        S.parse_line("[1]")


def read_rows(spark):
    """Rows that finished stages have read from files so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def test_blocks_that_cannot_reach_the_page_are_not_read(spark, tmp_path, monkeypatch):
    """The same rows with blocks as without, ties and filters too; and fewer rows are read."""
    monkeypatch.setattr(Q, "BLOCK_BITS", 4)
    monkeypatch.setattr(Q, "FIRST_BLOCKS", 3)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "8192")
    pick = random.Random(2)
    words = [f"w{n}" for n in range(60)]
    title = lambda n: " ".join(pick.choices(["often", *words], [20] + [1] * 60, k=pick.randint(1, 30)))
    rows = [(n, f"a{n}", title(n) + (" rare rare" if 500 <= n < 520 or n % 200 == 0 else ""), ("en", "fr")[n % 2], n % 3) for n in range(-20, 1000)]
    rows += [(n, f"a{n}", "often", "en", n % 3) for n in range(1000, 1060)]  # equal scores over many blocks
    docs = spark.createDataFrame(rows, "rid long, aa_id string, title string, language string, score_base_rank long")
    docs = docs.select(*(F.col(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RECORDS.fields))
    codes = spark.createDataFrame([], "rid long, kind string, value string")
    one = str(tmp_path / "one")
    G.append(spark, one, lambda last: (docs, codes))
    hadoop.unset("parquet.block.size")
    for target in (one,):
        c = G.opened(spark, target)
        for query, filters in (("often w1", Q.Filters("fr", limit=7)), ("rare often rare", Q.Filters(limit=3))):
            plain, began = Q.keyword(c.records, query, filters, c.index), read_rows(spark)
            expected = [(r.rid, r.bm25_score) for r in plain.collect()]
            read = read_rows(spark) - began
            for most in (512, 0) if query == "often w1" else (512,):
                monkeypatch.setattr(Q, "MOST_BLOCKS", most)
                began = read_rows(spark)
                got = [(r.rid, r.bm25_score) for r in Q.keyword(c.records, query, filters, c.index, c.blocks).collect()]
                assert got == expected, (query, most)
                if query == "rare often rare":
                    assert expected and read_rows(spark) - began < 0.7 * read, (read_rows(spark) - began, read)
