"""Operators without SQL counterparts: brute force and edge rows on small frames."""

import numpy as np
import pytest

from siltworks.operators import near_duplicates as nd
from siltworks.operators import relational, scores
from siltworks.operators import benchmarks, code, dialogues, documents, generation, language, quality_scores, serving, text2sql
from siltworks.operators.refiners import _REFINE, refine
from siltworks.operators.rule_filters import _RULES, keep
from siltworks.plans.pipeline import compile_pipeline
from siltworks.registry import available

EDGES = [None, "", " ", "\u3000", "a", "a:", "x" * 20_000, "word " * 5000, "é中😀", "a…\nb...", "&lt", "1.1.2020 $5", "!!??__"]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "id bigint, text string")


def test_every_rule_and_refiner_takes_edge_rows(edges):
    from pyspark.sql import functions as F

    more = {"blocklist_filter": {"blocked": ["word"]}}
    cols = {n: keep(n, F.col("text"), **more.get(n, {})) for n in _RULES} | {n: refine(n, F.col("text")) for n in _REFINE}
    assert edges.select("id", *[c.alias(n) for n, c in cols.items()]).count() == len(EDGES)
    first = edges.filter("id = 0").select(*[refine(n, F.col("text")).alias(n) for n in _REFINE]).first()
    assert all(v is None for v in first)


def test_empty_tables(edges):
    none = edges.limit(0)
    assert nd.minhash_deduplicate(none, "text", "id").count() == 0
    assert relational.chunks(none, "id", "text").count() == 0


def test_minhash_keeps_the_first_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base + " x"), (3, base), (4, "entirely different text about nothing at all"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert sorted(r.id for r in nd.minhash_deduplicate(df, "text", "id").collect()) == [1, 4, 5]
    assert sorted(r.id for r in nd.simhash_deduplicate(df, "text", "id").collect()) == [1, 4, 5]


def test_semantic_deduplicate_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 16))
    v[30:] = v[:30] + 0.01 * rng.standard_normal((30, 16))
    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "id bigint, v array<float>")
    assert sorted(r.id for r in nd.semantic_deduplicate(df, "v", "id").collect()) == list(range(30))


def test_scores():
    assert scores.extract_answer("so \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}" and scores.extract_answer("The answer is 42.") == "42" and scores.extract_answer("1,234 boxes") == "1234" and scores.extract_answer(None) is None
    assert scores.bleu1("a b c", "a b c") == pytest.approx(1, abs=1e-6) and scores.bleu1("", "a") == 0
    assert [scores.stem(w) for w in "running ponies relational hopping conditional adjustment probate".split()] == "run poni relat hop condit adjust probat".split()
    assert scores.mtld(["a"] * 60) < scores.mtld([str(i) for i in range(60)])


def test_token_f1(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("the cat sat", "a cat sat down"), ("yes", "no"), (None, "x"), ("", "")], "p string, t string")
    got = [r.f for r in df.select(relational.token_f1(F.col("p"), F.col("t")).alias("f")).collect()]
    assert got[0] == pytest.approx(0.8) and got[1:] == [0, 0, 0]


def test_models_and_pipeline(spark, edges):
    got = compile_pipeline(edges, [("content_null_filter", {"input_key": "text"}), ("lowercase_refiner", {"input_key": "text"})])
    assert got.count() == sum(bool(t and t.strip()) for t in EDGES)
    with pytest.raises(KeyError):
        compile_pipeline(edges, [("content_null_filter", {"input_key": "nowhere"})])
    assert len(available()) > 60


def test_k_center_and_vendi(spark):
    df = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(20)], "id bigint, v array<float>")
    assert scores.k_center(df, "id", "v", 4).count() == 4
    assert 1 <= scores.vendi(df, "v").first()["vendi"] <= 2.0001


def test_sources_and_stream(spark, tmp_path, edges):
    from siltworks.operators.rule_filters import general_filter
    from siltworks.sources.files import open_source, write
    from siltworks.streaming.apply import read_stream, run

    for kind in ("parquet", "json"):
        write(edges, f"{tmp_path}/{kind}", kind)
        assert open_source(spark, f"{tmp_path}/{kind}", kind).count() == len(EDGES)
    s = read_stream(spark, f"{tmp_path}/parquet", edges.schema)
    run(s, [lambda d: general_filter(d, [d["text"].isNotNull()])], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(EDGES) - 1


def test_leader_links_connect_what_brute_force_connects(spark, monkeypatch):
    from pyspark.sql import functions as F

    v = [0, 2, 4, 100, 102] + list(range(7, 95, 11))  # 1 and 2 are like each other; only 1 is like the leader 0
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id bigint, sketch bigint")
    for block in (2, 2048):
        monkeypatch.setattr(nd, "BLOCK", block)
        for keys, sketches in ((df.select("id", F.lit(1).alias("bucket")), df), (df.withColumn("bucket", F.lit(1)), None)):
            got = nd.group_links(nd.leader_links(keys, sketches, lambda a, b: F.abs(a - b) <= 2)).collect()
            assert {(r.node, r.component) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}


def test_registered_queries_do_the_whole_job(spark):
    from siltworks.plans import catalogue

    d = "/root/testdata/sf0.001"
    docs, q = spark.read.parquet(f"{d}/documents.parquet"), catalogue.queries()
    assert q["op_sql_component_classifier"](spark, d).count() == docs.count()
    assert sorted(r.doc_id for r in q["op_simhash_deduplicate"](spark, d).collect()) == sorted(r.doc_id for r in nd.simhash_deduplicate(docs, "text", "doc_id").collect())


def test_ngramhash_drops_what_shares_a_part_anywhere(spark):
    a, b, c = "x" * 10, "y" * 10, "z" * 10
    rows = [(1, a + b + c), (2, c + "q" * 10 + "r" * 10), (3, "no" * 15), (4, a + b + c + "!"), (5, None), (6, "q" * 10 + a + b)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert sorted(r.id for r in nd.ngramhash_deduplicate(df, "text", "id").collect()) == [1, 3, 5]
    assert sorted(r.id for r in nd.ngramhash_deduplicate(df, "text", "id", diff_size=2).collect()) == [1, 2, 3, 5]


def test_document_quality_against_brute_force(spark):
    import math
    import re
    from collections import Counter

    texts = ["a b a b c\nX Y\na b a b c\n", "", None, "{} {}", "ONE TWO one 1\r\n\r\nONE TWO", "w " * 3000]
    got = code.document_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).orderBy("id").collect()
    for r, t in zip(got, texts):
        w = re.findall(r"\w+", t or "")
        g = Counter(zip(w, w[1:]))
        n = Counter(w)
        assert r["CodeDocumentQualityWordCount"] == len(w)
        assert r["CodeDocumentQualityDuplicate_2Gram_RatioRatio"] == pytest.approx(sum(v for v in g.values() if v > 1) / max(1, sum(g.values())))
        assert r["CodeDocumentQualityEntropy"] == pytest.approx(-sum(v / len(w) * math.log2(v / len(w)) for v in n.values()))
        assert r["CodeDocumentQualityScore"] == (1.0 if t and w else 0.0)


def test_languages_and_perplexity(spark):
    en, de = "the people of the town were in the valley and it was cold", "die Leute in der Stadt waren im Tal und es war sehr kalt"
    m = language.LanguageModel.fit([("en", en)] * 3 + [("de", de)] * 3)
    assert m.rank("the town was cold")[0] == "en" and m.rank("die Stadt war kalt")[0] == "de" and m.rank("12 !") == [] == m.rank(None)
    c = language.CharacterModel.fit([en] * 5)
    assert c.perplexity("the valley was cold") < c.perplexity("qzx vvk wpf jjq") and c.perplexity(" ") is None is c.perplexity(None)
    df = spark.createDataFrame([(1, en), (2, de), (3, None), (4, "")], "id int, text string")
    assert [r.id for r in language.language_filter(df, "text", ["de"], m, most=1).collect()] == [2]
    got = quality_scores.range_filter(df, "perplexity", language.perplexities(c), ("text",), low=0, high=1e9)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_spelling_stems_dates_and_contractions(spark):
    s = scores.Speller({"people": 5, "purple": 4, "water": 3})
    assert [s(w) for w in ("peopel", "watr", "people", "xyzxyz", "pople")] == ["people", "water", "people", "xyzxyz", "people"]
    from pyspark.sql import functions as F

    def one(name, t):
        return spark.range(1).select(refine(name, F.lit(t)).alias("x")).first().x

    assert one("text_normalization_refiner", "On March 5, 2020 and 7 May 1999, or 1.2.20, $ 5") == "On 2020-03-05 and 1999-05-07, or 20-2-1, 5 USD"
    assert one("text_normalization_refiner", "Smarch 5, 2020; 31 April 2020") == "Smarch 5, 2020; 31 April 2020"
    assert one("remove_contractions_refiner", "I'm sure you can’t, Won't and don't; it's John's. THEY'RE they'd") == "I am sure you cannot, Will not and do not; it is John's. THEY are they would"


def test_readability_and_sandbox():
    r = scores.readability("The cat sat on the mat. It was a beautiful afternoon.")
    assert r["lexicon_count"] == 11 and r["sentence_count"] == 2 and r["polysyllable_count"] == 2 and scores.readability("1 2") is None
    assert dialogues.run_snippet("print(1)") == ("PASS", "1\n") and dialogues.run_snippet("1/0")[0] == "FAIL" and dialogues.run_snippet("while True: pass", 1)[0] == "FAIL" and dialogues.run_snippet(None)[0] == "FAIL"


def test_pages_and_parts(spark):
    page = "<html><head><title>t</title></head><body><h2>Head</h2><p>One <b>two</b> &amp; <a href='u'>three</a></p><ul><li>a<li>b</ul><script>x</script></body></html>"
    assert documents.html_to_markdown(page) == "## Head\n\nOne **two** & [three](u)\n\n- a\n- b" and documents.html_to_markdown(None) is None
    df = spark.createDataFrame([(1, "a.html", page), (2, "b.pdf", None), (3, "c.xml", "<a>x<b>y</b></a>"), (4, "d.md", "# h"), (5, None, None)], "id int, src string, body string")
    got = {r.id: (r.kind, r.text) for r in documents.to_markdown(df, "src", "body").collect()}
    assert got[2] == ("pdf", None) and got[3] == ("xml", "x\ny") and got[4] == ("text", "# h") and got[5] == ("text", None)
    t = spark.createDataFrame([(1, "One two. Three four five. Six."), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.chunk, r.raw_chunk) for r in documents.sentence_chunks(t, "id", "t", 5).orderBy("chunk").collect()] == [(1, 0, "One two. Three four five."), (1, 1, "Six.")]
    long = spark.createDataFrame([(1, ("word " * 30 + "\n\n") * 5 + "x" * 500)], "id int, t string")
    parts = [r.raw_chunk for r in documents.recursive_chunks(long, "id", "t", 100).collect()]
    assert all(len(p) <= 100 for p in parts) and sum(p.count("word") for p in parts) == 150 and sum(p.count("x") for p in parts) == 500


def test_chunk_files_and_their_cleaning(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text(f"One. Two {i}.")
    got = documents.chunk_files(spark, f"{tmp_path}/*.txt", f"{tmp_path}/chunks", lambda d: documents.sentence_chunks(d, "path", "content", 1))
    assert got.count() == 3
    new = documents.clean_chunk_files(spark, f"{tmp_path}/chunks", f"{tmp_path}/clean", serving.served(serving.FunctionBackend(lambda p: "<cleaned_start>" + p[-4:] + "<cleaned_end>")))
    assert new.count() == 3 and spark.read.json(f"{tmp_path}/clean").filter("cleaned_chunk IS NULL").count() == 0


def test_served_backend_and_tasks(spark, edges):
    out = generation.run_task(edges, "prompted_evaluator", serving.served(serving.FunctionBackend(lambda p: f"{len(p) % 7}")), {"raw_content": "text"})
    assert out.count() == len(EDGES) and out.filter("eval NOT BETWEEN 0 AND 5").count() == 0
    failing = generation.run_task(edges, "code_quality_sample_evaluator", serving.served(serving.FunctionBackend(lambda p: None)), {"instruction": "text", "code": "text"})
    assert {r.quality_score for r in failing.collect()} == {0}
    for name in generation.TASKS:  # every task takes edge rows and an empty table
        t = generation.TASKS[name]
        assert generation.run_task(edges, name, serving.stored("text"), dict.fromkeys(t.fields, "text")).limit(99).collect() is not None


def test_sqlite_engine_and_votes(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "d.db")
    con.executescript("CREATE TABLE t (a, b); INSERT INTO t VALUES (1, 'x'), (2, NULL);")
    con.close()
    folder = str(tmp_path)
    engine = text2sql.SqliteEngine(lambda db: f"{folder}/{db}.db")
    rows = [(1, "d", "SELECT a FROM t"), (2, "d", "SELECT c FROM t"), (3, "none", "SELECT a FROM t"), (4, "d", "DELETE FROM t"), (5, "d", "/* x */ with y as (select 1 as z) select z from y"), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, db_id string, SQL string")
    assert [r.id for r in text2sql.executability_filter(df, engine).orderBy("id").collect()] == [1, 5]
    assert [r.id for r in text2sql.execution_filter(df, engine).orderBy("id").collect()] == [1, 5]
    cots = spark.createDataFrame([(1, "d", ["```sql\nSELECT b FROM t WHERE a = 1\n```", "```sql\nSELECT a FROM t\n```", "```sql\nSELECT a FROM t ORDER BY a DESC\n```"]), (2, "d", []), (3, "d", None)], "id int, db_id string, cot_responses array<string>")
    assert [(r.id, r.SQL) for r in text2sql.vote(cots, "id", engine).collect()] == [(1, "SELECT a FROM t")]


def test_condor_and_consistent_chat(spark):
    from pyspark.sql import functions as F

    got = generation.condor_generate(spark, 6, {"a": ["x", "y"], "b": ["z"]}, lambda p: F.lit("[Easy] e? [Medium] m? [Hard] h?"), lambda p: p).collect()
    assert len(got) == 18 and {r.difficulty for r in got} == {"Easy", "Medium", "Hard"}
    chat = dialogues.consistent_chat(spark, {"c": ["t"]}, lambda p: F.lit('["q1", "q2", "q3"]'), lambda p: F.lit('["a1", "a2"]'), 2).collect()
    assert len(chat) == 2 and [m.content for m in chat[0].conversation] == ["q1", "a1", "q2", "a2"]


def test_sources_of_several_kinds(spark, tmp_path):
    import zipfile

    import pandas as pd

    from siltworks.sources import files

    pd.DataFrame({"a": [1, 2], "b": ["x", "y"]}).to_pickle(f"{tmp_path}/p.pkl")
    pd.DataFrame({"a": [3], "b": ["z"]}).to_pickle(f"{tmp_path}/q.pkl")
    assert files.open_source(spark, [f"{tmp_path}/p.pkl", f"{tmp_path}/q.pkl"]).count() == 3
    (tmp_path / "one.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "lines.jsonl").write_text('{"a": 3}\n{"a": 4, "b": "x"}\n')
    got = files.open_source(spark, [f"{tmp_path}/lines.jsonl", f"{tmp_path}/one.json"])
    assert sorted(r.a for r in got.collect()) == [1, 2, 3, 4]
    with zipfile.ZipFile(f"{tmp_path}/w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>text</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="A3"><v>8</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in files.open_source(spark, f"{tmp_path}/w.xlsx").orderBy("id").collect()] == [(7, "ab"), (8, None)]
    rows = files.generate_rows(spark, lambda p: ({"p": p, "i": i} for i in range(5)), "p int, i int", 3, 2)
    assert rows.count() == 15 and rows.select("p").distinct().count() == 3
    assert files.open_media(spark, str(tmp_path), ".pkl").count() == 2
    with pytest.raises(ValueError):
        files.open_source(spark, "x.unknown")


def test_pipelines_go_on_where_they_ended(spark, tmp_path, edges):
    from siltworks.plans.pipeline import run_pipeline, step_names

    first = [("content_null_filter", {"input_key": "text"})]
    steps = [*first, ("lowercase_refiner", {"input_key": "text"})]
    assert run_pipeline(edges, first, f"{tmp_path}/p").count() == run_pipeline(edges.limit(0), steps, f"{tmp_path}/p").count() > 0
    assert run_pipeline(edges.limit(0), steps, f"{tmp_path}/p", 0).count() == 0
    assert step_names(steps)[0] == step_names(first)[0] != step_names([("content_null_filter", {"input_key": "t"})])[0]


def test_encoded_data_of_any_length_against_brute_force(spark):
    import random
    import re

    r = random.Random(8)
    kinds = [["ab ", "7F ", "a0\n", "ab  ", "0x1f "], ["0x1f,", "a0,", "0xA7,", "0x1f ,"], ["\\x41", "\\xfe", "\\x0g"], ["\\u00e9", "\\u20AC", "\\u00g9"], ["QUJD", "a+/=", "\n", "-"]]
    texts = ["".join(r.choice(r.choice(kinds) if r.random() < 0.03 else kind) for _ in range(r.randint(5, 60))) for kind in kinds for _ in range(100)]
    texts += [t * 50_000 for t in ("0x1f,", "0x1f, ", "\\x1f", "1f ", "1f\n", "\\u00e9", "QUJD")] + ["1f " * 50_000 + "?", None, ""]
    rules = {"Base64": r"[a-zA-Z0-9+/=\n]{64,}", "Hex": r"(?:\b(?:0x|\\x)?[0-9a-fA-F]{2}(?:,|\b\s*)){8,}", "Unicode": r"(?:\\u[0-9a-fA-F]{4}){8,}"}
    got = code.encoded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).orderBy("id").collect()
    want = [{k: sum(map(len, re.findall(p, t or ""))) / max(len(t or ""), 1) for k, p in rules.items()} for t in texts]
    assert len(got) == len(texts) and sum(0 < w["Hex"] < 1 for w in want) > 50 and sum(0 < w["Unicode"] < 1 for w in want) > 5
    for g, w in zip(got, want):
        assert {k: g[f"CodeEncodedData{k}Ratio"] for k in rules} == pytest.approx(w)
        assert g.CodeEncodedDataScore == (0.0 if max(w.values()) > 0.5 else 1.0)
