import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievewright.config import SearchConfig
from sievewright.operators.cache import Cache, answer_of, last_wins
from sievewright.operators.judge import LexicalJudge, Rejected
from sievewright.operators.relational import not_within, sample_exactly, sorted_concat, survivors
from sievewright.plans.pipeline import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import the tests

FILES = [("a.py", 0, "class Session:\n    def open(self):\n        return 1\n", True), ("b.py", 1, "class Other:\n    pass\n", True), ("c.md", 2, "The session is opened here.\nNothing else.\n", False), ("c.md", 3, "The session is opened here.\nNothing else.\n", False)]
SCHEMA = "path string, ord long, text string, parseable boolean"
QUESTION = "where is the session opened?"


class Counting(LexicalJudge):
    def __init__(self, log):
        self.log = log

    def ask(self, messages, model):
        with open(self.log, "a") as f:
            f.write("x")
        return super().ask(messages, model)


class Failing(LexicalJudge):
    def ask(self, messages, model):
        if "c.md" in messages[1]["content"]:
            raise Rejected("no")
        return super().ask(messages, model)


def config(**more):
    return SearchConfig(concurrency=4, threads=2, **more)


def test_findings_of_each_file(spark):
    out = search(spark.createDataFrame(FILES, SCHEMA), QUESTION, LexicalJudge(), config(refine=False))
    got = {r["path"]: r["context"] for r in out.contexts.collect()}
    assert set(got) == {"a.py", "c.md"} and got["c.md"] == "File: c.md\nThe session is opened here."
    assert out.errors.count() == 0 and out.render().startswith("File: a.py")


def test_refined_and_independent_of_order(spark):
    one = search(spark.createDataFrame(FILES, SCHEMA), QUESTION, LexicalJudge(), config()).render()
    two = search(spark.createDataFrame(FILES[::-1], SCHEMA).repartition(3), QUESTION, LexicalJudge(), config()).render()
    assert one == two and "session" in one


def test_without_outlines_every_file_is_read(spark):
    out = search(spark.createDataFrame(FILES, SCHEMA), QUESTION, LexicalJudge(), config(refine=False, analyze_skeletons=False))
    assert {r["path"] for r in out.contexts.collect()} == {"a.py", "b.py", "c.md"}


def test_errors_are_rows(spark):
    out = search(spark.createDataFrame(FILES, SCHEMA), QUESTION, Failing(), config(refine=False))
    assert [r["kind"] for r in out.errors.collect()] == ["request"]
    assert "[File: c.md]" in out.error_lines().first()["line"]
    assert {r["path"] for r in out.contexts.collect()} == {"a.py"}


def test_a_warm_cache_makes_no_call(spark, tmp_path):
    store, files = Cache(spark, str(tmp_path / "cache")), spark.createDataFrame(FILES, SCHEMA)
    log = tmp_path / "log"
    first = search(files, QUESTION, Counting(str(log)), config(), store).render()
    calls = len(log.read_text())
    assert calls == 5  # one batch, two sources (equal ones once), two passes over one group
    assert search(files, QUESTION, Counting(str(log)), config(), store).render() == first
    assert len(log.read_text()) == calls
    before = store.rows().count()
    store.delete(store.rows().select("cache_key").limit(1))
    assert store.rows().count() == before - 1


def test_no_files(spark):
    with pytest.raises(ValueError):
        search(spark.createDataFrame([], SCHEMA), QUESTION, LexicalJudge(), config())


def test_small_operators(spark):
    rows = spark.createDataFrame([("k", "v1", 1, 1), ("k", "v2", 1, 2), (None, "v3", 1, 1), ("j", None, 1, 1)], "cache_key string, response string, ts int, seq int")
    got = {r["cache_key"]: r["response"] for r in last_wins(rows).collect()}
    assert got == {"k": "v2", None: "v3", "j": None}
    j = spark.createDataFrame([('{"answer": "a"}',), ("{'answer': 'a'}",), ("",), (None,), ("{",)], "r string")
    assert [r[0] for r in j.select(answer_of(F.col("r"))).collect()] == ["a", None, None, None, None]
    ids = spark.range(50).selectExpr("id AS k")
    assert sample_exactly(ids, 7, 3, "k").count() == 7 and sample_exactly(ids, 7, 3, "k").collect() == sample_exactly(ids.repartition(5), 7, 3, "k").collect()
    assert sample_exactly(ids, 0, 3, "k").count() == 50 and sample_exactly(ids, 500, 3, "k").count() == 50
    a = spark.createDataFrame([(1, "see xa.py")], "g int, answer string")
    m = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (2, "a.py")], "g int, path string")
    assert [r["path"] for r in survivors(a, m, "g").collect()] == ["a.py"]
    t = spark.createDataFrame([("k", x) for x in ("b", "a", "c" * 50, None, "a")] + [("h", "z")], "k string, t string")
    assert {r["k"]: r["t"] for r in sorted_concat(t, "k", "t", between="|").collect()} == {"k": "a|a|b|" + "c" * 50, "h": "z"}
    assert {r["k"]: r["t"] for r in sorted_concat(t, "k", "t", 7, "|").collect()} == {"k": "a|a|b|c", "h": "z"}
    s = spark.createDataFrame([("p", "z", 0, 9), ("p", "a", 1, 9), ("p", "a", 9, 12)], "path string, type string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in not_within(s, F.col("type") == "z").collect()) == [(0, 9), (9, 12)]


def test_stream_and_sources(spark, tmp_path):
    from sievewright.sources.scan import existing, listing, missing, path_list, whole_files, write_errors, write_text
    from sievewright.streaming.files import file_stream, search_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_bytes(b"x = 1\r\ny = 2\r")
    (tmp_path / "in/b.txt").write_text("b")
    rows = {r["path"].rsplit("/", 1)[1]: r["text"] for r in whole_files(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.py": "x = 1\ny = 2\n", "b.txt": "b"}
    files = listing(spark, str(tmp_path / "in"))
    paths = path_list(spark, [f" {tmp_path}/in/a.py", "", f"{tmp_path}/in/none.py"])
    assert existing(paths, files).count() == 1 and missing(paths, files).count() == 1
    stream = file_stream(spark, str(tmp_path / "in"))
    search_stream(stream, lambda f: f.select("path", "parseable"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["parseable"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True]
    write_text(spark.createDataFrame([("t",)], "text string"), str(tmp_path / "text"))
    write_errors(spark.createDataFrame([("timeout", "m", "p", None)], "kind string, message string, path string, cause string"), str(tmp_path / "errors"))
    assert spark.read.text(str(tmp_path / "text")).count() == 1 and spark.read.json(str(tmp_path / "errors")).first()["kind"] == "timeout"


def test_command_line(tmp_path, capsys, spark, monkeypatch):
    from sievewright.cli import main

    monkeypatch.setenv("SIEVEWRIGHT_CACHE_DIR", str(tmp_path / "cache"))
    f = tmp_path / "a.py"
    f.write_text(FILES[0][2])
    assert main(["tokens", str(f)]) == 0 and str(f) in capsys.readouterr().out
    assert main(["outline", str(f)]) == 0 and "{...}" in capsys.readouterr().out
    assert main([QUESTION], [str(tmp_path / "none")]) == 1
    capsys.readouterr()
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\xff")
    assert main([QUESTION, "--no-refine", "--concurrency", "2"], [str(f), str(tmp_path / "none"), str(tmp_path / "bad.py")]) == 0
    shown = capsys.readouterr()
    assert "class Session" in shown.out and "none is not a file" in shown.err and "unreadable" in shown.err and "lines received" in shown.err
    assert Cache(spark, str(tmp_path / "cache")).rows().count() == 2  # by default answers are kept


def test_condensing_of_all_notes(spark, tmp_path):
    from sievewright.plans.queries import QUERIES

    long = "a line of well over sixty characters that a note may hold as well as any shorter one, number "
    notes = [(k, ["w", None, "archive"][k % 3], "\n".join(f"{long}{j} of {k // 2}" for j in range(300 + 60 * k))) for k in range(18)]
    notes += [(18, "w", None), (19, None, "short"), (20, "w", " \n"), (21, "archive", "x" * (4 * 54_000 + 1)), (22, None, "y" * (4 * 54_000))]
    spark.createDataFrame(notes, "seq long, source string, response string").write.parquet(str(tmp_path / "responses.parquet"))
    groups, held, large = [], 0, []
    for path, text in sorted((f"{source or ''}/{seq:012d}", text) for seq, source, text in notes if text is not None):
        size = (len(text) + 3) // 4
        if size > 54_000:
            large.append((1 << 62, path, f"File: {path}\n{text}"))
            continue
        if not groups or held + size > 54_000:
            groups, held = [*groups, set()], 0
        held += size
        groups[-1].update(x for x in text.split("\n") if x.strip())
    once = ["\n".join(sorted(g)) or "nothing relevant" for g in groups]
    got = QUERIES["semantic_condense_notes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, "", f"{x}\n\n{x}") for k, x in enumerate(once)] + large
    assert len(groups) > 3 and len(large) == 1


def test_captures_not_within_equal_brute_force(spark, tmp_path):
    from sievewright.operators.scanners import CLASS_LIKE, items_of
    from sievewright.plans.queries import QUERIES

    java = "import x.Y;\nclass A {\n  int f;\n  void m() { }\n  class B { void n() { } }\n}\ninterface C { void p(); }\n"
    files = [(1, "a/A.java", java), (2, "a/b.PY", "def f():\n    pass\n\nclass K:\n    def g(self):\n        pass\n"), (3, "c.cs", "class D { int P { get; } void M() { } }"), (4, "d.md", java), (5, "e.java", None), (6, "f.java", "")]
    spark.createDataFrame(files, "file_id long, file_path string, text string").write.parquet(str(tmp_path / "source_text.parquet"))
    want = []
    for i, path, text in files:
        if text is None or path.endswith(".md"):
            continue
        spans = [(x.kind, x.start, x.end) for x in items_of(text, path[path.rindex(".") :].lower())]
        left = [b for b in spans if not any(a != b and a[0] in CLASS_LIKE and a[1] <= b[1] and b[2] <= a[2] for a in spans)]
        want += [(i, *b, k, None) for k, b in enumerate(sorted(left, key=lambda b: (b[1], b[2], b[0])), 1)]
    got = QUERIES["captures_not_within"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r["file_id"] for r in got} == {1, 2, 3} and len(got) < 9


def test_answers_are_kept_though_the_stage_fails(spark, tmp_path, monkeypatch):
    from sievewright.operators import judge as judging
    from sievewright.plans import pipeline

    class Dying(LexicalJudge):
        def ask(self, messages, model):
            if messages[0]["content"] == "die":
                raise SystemExit("the worker is lost")
            return "kept"

    store = Cache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([(str(k), "m", [("user", "die" if k == 99 else f"q{k}")], "p") for k in range(100)], "cache_key string, model string, messages array<struct<role:string,content:string>>, path string")
    monkeypatch.setattr(judging, "STORE_ROWS", 10)
    with pytest.raises(Exception):  # noqa: B017
        pipeline.answered(rows.coalesce(1), Dying(), config(), store)
    assert store.rows().count() >= 50
    good = pipeline.answered(rows.where("cache_key <> '99'"), Dying(), config(), store)
    assert good.where("answer = 'kept'").count() == 99 and good.where("from_cache").count() >= 50


def test_a_delete_that_was_broken_off(spark, tmp_path):
    path = str(tmp_path / "cache")
    Cache(spark, path).upsert(spark.createDataFrame([("a", "1"), ("b", "2")], "cache_key string, response string"))
    (tmp_path / "cache").rename(tmp_path / "cache-before")
    store = Cache(spark, path)
    assert store.rows().count() == 2
    store.delete(spark.createDataFrame([("a",)], "cache_key string"))
    assert [r["cache_key"] for r in store.rows().collect()] == ["b"] and not (tmp_path / "cache-before").exists()


def test_the_newest_version_of_a_path(spark):
    files = [("a.py", 5, "class Session:\n    pass\n", True), ("a.py", 9, "class Other:\n    pass\n", True), ("a.py", 1, "class Session2:\n    pass\n", True)]
    out = search(spark.createDataFrame(files, SCHEMA).repartition(3), QUESTION, LexicalJudge(), config(refine=False))
    assert out.contexts.count() == 0
    files[1] = ("a.py", 9, "class SessionNow:\n    pass\n", True)
    (row,) = search(spark.createDataFrame(files, SCHEMA).repartition(3), QUESTION, LexicalJudge(), config(refine=False)).contexts.collect()
    assert "SessionNow" in row["context"]


def test_warnings_and_a_tokenizer(spark):
    import os

    file = "/opt/tokenizers/byte_bpe_50k.json"
    text = "The session is opened here. " * 40 + "\n"
    files = spark.createDataFrame([("c.md", 0, text * 3, False), ("d.md", 1, "The session.", False)], SCHEMA)
    out = search(files, QUESTION, LexicalJudge(), config(refine=False, input_tokens=100))
    assert {r["path"] for r in out.warnings.collect()} == {"c.md"}
    assert max(len(r["context"]) for r in out.contexts.collect()) <= len("File: c.md\n") + 400
    if os.path.exists(file):
        from sievewright.functions.tokens import BpeCounter

        by_token = search(files, QUESTION, LexicalJudge(), config(refine=False, input_tokens=100, tokenizer=file))
        assert {r["path"] for r in by_token.warnings.collect()} == {"c.md"}
        counter = BpeCounter(spark, file)
        cut = counter.cut(F.col("t"), 7)
        (row,) = spark.createDataFrame([(text,)], "t string").select(counter.count(F.col("t")).alias("n"), cut.alias("c"), counter.count(cut).alias("m")).collect()
        assert row["m"] == 7 < row["n"] and text.startswith(row["c"])


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from sievewright.functions import arrow

    class Remote:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf = {}
        sparkContext = Remote()  # noqa: N815

    with pytest.raises(RuntimeError):
        arrow.shared_path(Session(), "x")
