import pytest

from sievewright.operators.outline import chunked, chunks, outline, outlines, tokens

JAVA = """package p;

@Service
public class A extends B {
    private int x = 1;

    public A() { }

    @Override
    public <T> List<T> f(int n) throws E {
        return null;
    }

    abstract void g();

    static class N {
        int y;
    }
}
"""
PYTHON = '''import os

class Foo(Base):
    """Doc."""
    limit = 3

    def __init__(self, a):
        self.a = a

    async def run(self) -> int:
        other.b = 2
        return 1

def top(x):
    return x
'''
SHARP = """using System;

namespace N
{
    public class C
    {
        private int _x;
        public int P { get; set; }
        public C() { }
        public int M(int a) { return a; }
    }
}
"""


def test_java():
    assert outline(JAVA, ".java").split("\n") == ["@Service", "public class A extends B {", "    private int x = 1;", "    List<T> f(int n) throws E {...}", "    void g();", "    static class N {", "        int y;", "    }", "}"]
    (chunk, cut), = chunks(JAVA, ".java", 1000)
    assert not cut and chunk.startswith("@Service\npublic class A extends B {\n    private int x = 1;\n\n@Override") and chunk.endswith("\n}") and "static class N {\n        int y;" in chunk and "public A()" not in chunk


def test_python():
    assert outline(PYTHON, ".py").split("\n") == ["class Foo(Base): {", "    def __init__(self, a): {...}", "        self.a = a", "    async def run(self) -> int: {...}", "def top(x): {...}", "}"]
    (chunk, _), = chunks(PYTHON, ".py", 1000)
    assert chunk.startswith("class Foo(Base):") and chunk.endswith("def top(x):\n    return x")


def test_sharp():
    assert outline(SHARP, ".cs").split("\n") == ["using System;", "    public class C {", "        private int _x;", "        int M(int a) {...}", "    }"]
    (chunk, _), = chunks(SHARP, ".cs", 1000)
    assert chunk.startswith("using System;\n\npublic class C\n")


def test_broken_python_goes_by_indentation():
    text = "class A:\n    def f(self):\n        return (\n\n    def g(self):\n        pass\n"
    assert outline(text, ".py") == "class A: {\n    def f(self): {...}\n    def g(self): {...}\n}"


@pytest.mark.parametrize("limit", [5, 20, 60])
def test_small_budgets(limit):
    for text, ext in ((JAVA, ".java"), (PYTHON, ".py"), (SHARP, ".cs")):
        out = list(chunks(text, ext, limit))
        assert out
        head = 2 + text.count("class")  # separators and closing braces are not counted
        assert all(tokens(c) <= limit + limit // 2 + head + 8 for c, _ in out)


def test_file_without_captures_and_with_fields_alone():
    assert list(chunks("int x", ".java", 10)) == [("int x", False)]
    assert list(chunks("class A {\n    int x;\n}\n", ".java", 100)) == [("class A {\n    int x;\n}", False)]


def test_tables(spark):
    rows = [(1, "a/B.JAVA", JAVA), (2, "c.py", None), (3, None, "x"), (4, "d.go", "y" * 100), (5, "e.py", "")]
    df = spark.createDataFrame(rows, "file_id long, file_path string, text string").selectExpr("*", "1 AS path", "2 AS chunk")
    got = {r["file_id"]: r for r in outlines(df).collect()}
    assert set(got) == {1, 2, 5} and got[2]["text"] is None and got[1]["text"].startswith("@Service")
    cut = {r["file_id"]: r for r in chunked(df, 10).where("chunk_no = 0").collect()}
    assert set(cut) == {1, 2, 3, 4, 5} and cut[4]["was_truncated"] and len(cut[4]["chunk"]) == 40
