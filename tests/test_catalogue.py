import gzip
import json
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.functions import leaves as L
from quillspark.functions import text as X
from quillspark.operators import catalogue as G
from quillspark.operators import expand as E
from quillspark.operators import ingest as I
from quillspark.operators import linking as K
from quillspark.operators import naming as N
from quillspark.operators import search as Q
from quillspark.schema import RECORDS, SEARCHED
from quillspark.sources import shards as S


def record(rid, **values):
    return tuple(values.get(f.name, rid if f.name == "rid" else f"a{rid}" if f.name == "aa_id" else None) for f in RECORDS.fields)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [
        record(1, title="Large language models", author="Ana Café", description="a large study of large-scale models", language="en", extension="pdf", year=2024, score_base_rank=3, original_filename="Llm.PDF"),
        record(2, title="Health trials", author="Bo", subjects="large ; trials", language="EN", extension="PDF", year=2015),
        record(3, title="x x x", description="foo bar foo-bar", language="fr"),
        record(4),
    ]
    records = spark.createDataFrame(rows, RECORDS)
    codes = spark.createDataFrame([(1, "isbn13", "9780000000001"), (1, "md5", "AB" * 16), (2, "md5", "ab" * 16), (2, "doi", "10.1/X"), (3, "isbn10", "000000000X")], "rid long, kind string, value string")
    return records, codes


@pytest.mark.parametrize("query", ["large", "large models", '"large language"', "foo-bar", '"x x"', "large large", "cafe", "trials bo"])
def test_scores_equal_fts5(catalogue, query):
    records, _ = catalogue
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(SEARCHED)}, tokenize='unicode61 remove_diacritics 2')")
    for r in records.collect():
        db.execute(f"INSERT INTO f(rowid, {', '.join(SEARCHED)}) VALUES (?{', ?' * 6})", (r.rid, *(r[c] for c in SEARCHED)))
    expected = dict(db.execute(f"SELECT rowid, bm25(f, {', '.join(map(str, SEARCHED.values()))}) FROM f WHERE f MATCH ?", (Q.match_expression(query),)))
    got = {r.rid: r.bm25_score for r in Q.scored(*Q.index(records), query).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in got)


def test_units():
    assert Q.units('one "two  three" four"five') == ["one", "two  three", "four", "five"]
    with pytest.raises(ValueError):
        Q.units(' "" ')


def test_filters_and_lookups(catalogue):
    records, codes = catalogue
    assert [r.rid for r in Q.keyword(records, "large", Q.Filters("En", "pdf")).collect()] == [1, 2]
    assert Q.keyword_count(records, "large", Q.Filters(year=2015)).head().hits == 1
    assert [r.rid for r in Q.exact(records, codes, ["md5"], "aB" * 16).collect()] == [1, 2]
    assert Q.resolve_one(records, codes, isbn="000000000x").rid == 3
    with pytest.raises(LookupError, match="more than one"):
        Q.resolve_one(records, codes, md5="ab" * 16)
    with pytest.raises(LookupError, match="no record"):
        Q.resolve_one(records, codes, aa_id="zz")
    with pytest.raises(ValueError):
        Q.resolve(records, codes, aa_id="a", md5="b")


def test_expansion(spark, catalogue, tmp_path):
    records, _ = catalogue
    cache, provider = E.Cache(spark, str(tmp_path / "cache")), E.TableProvider({"llm": ["large models", "LLM", "a/b", "zz", "large  models"]})
    rows, said = E.expanded_search(records, "llm", Q.Filters(), provider, cache)
    assert [r.rid for r in rows.collect()] == [1] and [a["text"] for a in said["accepted"]] == ["large models"]
    assert [r["reason"] for r in said["rejected"]] == ["literal", "identifier or path", "no hits", "repeated"]
    assert E.expanded_search(records, "llm", Q.Filters(), provider, cache)[1]["cache_hit"]
    assert E.skip_reason("ab" * 10) == "identifier or path" and E.skip_reason("plain words") is None


def test_build(spark, tmp_path):
    doc = {"_source": {"id": " d1 ", "search_only_fields": {"search_title": " A  title ", "search_year": "2024", "search_filesize": "42", "search_most_likely_language_code": ["en", "de"]}, "file_unified_data": {"identifiers_unified": {"md5": ["m", "m"], "isbn13": "9"}, "has_torrent_paths": "no", "classifications_unified": {"openlib_subject": ["Art", "ART", "/x"], "lgrsnf_topic": 3.0}, "filesize_best": 7}}}
    src = tmp_path / "in"
    src.mkdir()
    for n, name in ((10, "late"), (2, "early")):
        doc["_source"]["id"] = f" {name} "
        with gzip.open(src / f"aarecords__{n}.json.gz", "wt") as f:
            f.write("\n" + json.dumps(doc) + "\n  \n")
    made = I.build(spark, str(src), str(tmp_path / "out"))
    assert (made["records"], made["codes"]) == (2, 4) and [s["lines"] for s in made["shards"]] == [1, 1]
    built = G.opened(spark, str(tmp_path / "out"))
    rows = built.records.orderBy("rid").collect()
    assert [r.rid for r in Q.keyword(built.records, "title", built=built.index).orderBy("rid").collect()] == [1, 2]
    assert [(r.rid, r.aa_id, r.title, r.year, r.filesize, r.language, r.subjects, r.has_torrent_paths) for r in rows] == [(1, "early", "A title", 2024, 42, "en", "Art", 0), (2, "late", "A title", 2024, 42, "en", "Art", 0)]
    with gzip.open(src / "aarecords__3.json.gz", "wt") as f:
        f.write("{bad\n")
    with pytest.raises(Exception, match="aarecords__3.json.gz, line 1"):
        I.build(spark, str(src), str(tmp_path / "out"), replace=True)
    assert G.opened(spark, str(tmp_path / "out")).records.count() == 2  # the failed build left the old catalogue
    assert S.spread(7, 3) == [3, 2, 2]


def test_leaves(spark):
    deep = "[" * 40 + '"x [ y"' + "]" * 40
    rows = spark.createDataFrame([(1, deep), (2, '["a", [1, [2.50, true]], "]["]'), (3, "null"), (4, '"s"'), (5, "[]")], "n int, j string")
    got = {r.n: r.t for r in rows.select("n", L.texts(F.parse_json("j")).alias("t")).collect()}
    assert got == {1: ["x [ y"], 2: ["a", "1", "2.5", "true", "]["], 3: None, 4: ["s"], 5: []}
    with pytest.raises(Exception, match="a null or an object"):
        spark.range(1).select(L.texts(F.parse_json(F.lit('[1, [null]]')))).collect()
    assert spark.range(1).select(L.texts(F.parse_json(F.lit('[1, [null, {"a": 1}, 2]]')), False).alias("t")).head().t == ["1", "2"]


def test_a_row_for_each_code_parses_a_document_once(spark):
    """a condition on the codes was pushed below the parsing, where each leaf that it named parsed the document again."""
    lines = spark.range(3).select("id", F.concat(F.lit('{"_source":{"id":"a","file_unified_data":{"identifiers_unified":{"md5":["m","m"],"doi":"'), "id", F.lit('"}}}}')).alias("j"))
    rows = I.flattened(lines.unionByName(spark.createDataFrame([(3, '{"_source":{"id":"b"}}')], "id long, j string")).select(F.col("id").alias("rid"), F.parse_json("j").alias("doc")))
    got = I.codes_by_row(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 2  # one for each side of the union
    assert sorted(map(tuple, got.collect())) == [(n, at, kind, value) for n in range(3) for at, (kind, value) in enumerate((("md5", "m"), ("doi", str(n))))]


def test_subjects_are_found_once(spark):
    """F16: the whole list was built again for each of its subjects."""
    lists = spark.createDataFrame([(["Art", "/a", "ART"], ["art", "Zoo"])], "one array<string>, two array<string>")
    got = lists.select(I.subjects_of([F.col("one"), F.col("two")]).alias("s"))
    assert got.head().s == "Art ; Zoo"
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("coalesce(one#") == 1


def test_leaves_of_one_kind(spark):
    docs = spark.createDataFrame([(1, '["a", null]'), (2, '[{"b": 1}, "c"]'), (3, '["x", "y"]'), (4, "[[1]]"), (5, "[true, false]")], "n int, j string").select("n", F.parse_json("j").alias("leaf"))
    assert [tuple(r) for r in docs.select("n", L.texts(F.col("leaf"), False)).orderBy("n").collect()] == [(1, ["a"]), (2, ["c"]), (3, ["x", "y"]), (4, ["1"]), (5, ["true", "false"])]
    for n in (1, 2):
        with pytest.raises(Exception, match="a null or an object"):
            docs.where(F.col("n") == n).select(L.texts(F.col("leaf"))).collect()


def test_text_functions(spark):
    row = spark.createDataFrame([(" a \u0085b ", "À-Bc [1999]", "x_" + "aF" * 16 + " 978-0-123456-78-9 [012345678x]")], "a string, b string, c string").select(
        X.clean(F.col("a")), X.for_match(F.col("b")), X.ascii_lower(F.col("b")), X.md5_candidates(F.col("c")), X.isbn13_candidates(F.col("c")), X.isbn10_candidates(F.col("c")), X.tokens(F.col("b")))
    assert tuple(row.head()) == ("a b", "bc 1999", "À-bc [1999]", ["af" * 16], ["9780123456789"], ["012345678X"], ["a", "bc", "1999"])


def test_linking(spark, catalogue):
    records, codes = catalogue
    files = spark.createDataFrame([("/f/1 9780000000001.pdf", None), ("/f/2 llm.pdf", None), ("/f/LLM.pdf", None), ("/f/b/" + "ab" * 16, None), ("/f/large language models ana caf.txt", None), ("/f/large language models ana.txt", None), ("/f/zz", None)], "path string, content_md5 string")
    found = K.features(files)
    dry = {r.path: (r.status, r.rid) for r in K.link_independent(found, records, codes).collect()}
    assert dry["/f/1 9780000000001.pdf"] == ("matched", 1) and dry["/f/LLM.pdf"] == ("matched", 1) and dry["/f/b/" + "ab" * 16] == ("ambiguous", None) and dry["/f/zz"] == ("unmatched", None)
    # every term has to be in the index, which holds "cafe" for the author's "Café"; a file name's "caf" is not that term
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(author, tokenize='unicode61 remove_diacritics 2')")
    db.execute("INSERT INTO f VALUES ('Ana Café')")
    assert [db.execute("SELECT count(*) FROM f WHERE f MATCH ?", (q,)).fetchone()[0] for q in ('"caf"', '"ana"')] == [0, 1]
    assert dry["/f/large language models ana caf.txt"] == ("unmatched", None) and dry["/f/large language models ana.txt"] == ("matched", 1)
    greedy = {r.path: (r.status, r.rid) for r in K.link_greedy(found, records, codes).collect()}
    assert greedy["/f/1 9780000000001.pdf"] == ("matched", 1) and greedy["/f/LLM.pdf"][0] == "unmatched" and greedy["/f/b/" + "ab" * 16] == ("matched", 2)
    assert K.statistics(K.link_greedy(found, records, codes)).head().matched == 2


def test_naming_and_config(spark, catalogue, tmp_path):
    records, _ = catalogue
    assert [r[0] for r in records.orderBy("rid").select(N.default_name("flat")).collect()] == ["Large language models -- Ana Café.pdf", "Health trials -- Bo.PDF", "x x x.bin", "a4.bin"]
    assert (N.resume(206, 5, "bytes 5-9/10"), N.resume(200, 5, None), N.resume(416, 5, "bytes */5"), N.resume(206, 5, "bytes 4-9/10")) == ("append", "restart", "complete", "error")
    got = config.resolved({"downloads": " "}, {"downloads": "~/d"}, {"HOME": "/h", "XDG_DATA_HOME": "/x"})
    assert got["downloads"] == config.Setting("/h/d", "config_file") and got["catalogue"].origin == "xdg"


def test_shard_names_are_no_patterns(spark, tmp_path):
    src = tmp_path / "a b[1] {x}%"
    src.mkdir()
    for n in (10, 2):
        with gzip.open(src / f"aarecords__{n}.json.gz", "wt") as f:
            f.write(f'{{"n": {n}}}\n')
    rows = S.read_lines(spark, S.discover(spark, str(src))).orderBy("shard").collect()
    assert [(r.shard, r.value) for r in rows] == [(0, '{"n": 2}'), (1, '{"n": 10}')]
