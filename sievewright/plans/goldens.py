"""Small sources with the outlines and chunks that were written down for them by hand, as the measure of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LIMIT = 1000

_JAVA = """package p;

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
_JAVA_OUTLINE = """@Service
public class A extends B {
    private int x = 1;
    List<T> f(int n) throws E {...}
    void g();
    static class N {
        int y;
    }
}"""
_JAVA_CHUNK = """@Service
public class A extends B {
    private int x = 1;

@Override
    public <T> List<T> f(int n) throws E {
        return null;
    }

abstract void g();

static class N {
        int y;
    }
}"""
_PYTHON = '''import os

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
_PYTHON_OUTLINE = """class Foo(Base): {
    def __init__(self, a): {...}
        self.a = a
    async def run(self) -> int: {...}
def top(x): {...}
}"""
_SHARP = """using System;

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
_SHARP_OUTLINE = """using System;
    public class C {
        private int _x;
        int M(int a) {...}
    }"""
_SHARP_CHUNK = """using System;

public class C
    {
        private int _x;
        public int P { get; set; }
        public C() { }
        public int M(int a) { return a; }
    }"""
_TWO = "class A {\n    int a;\n    void f() { }\n}\ninterface I {\n    void g();\n}\nclass B {\n    void h() { }\n}\n"

#: path, text, outline, chunks.
CASES: list[tuple[str, str, str, list[str]]] = [
    ("r/A.java", _JAVA, _JAVA_OUTLINE, [_JAVA_CHUNK]),
    ("r/foo.PY", _PYTHON, _PYTHON_OUTLINE, [_PYTHON.split("\n\n", 1)[1].rstrip()]),
    ("r/C.cs", _SHARP, _SHARP_OUTLINE, [_SHARP_CHUNK]),
    ("r/Two.java", _TWO, "class A {\n    int a;\n    void f() {...}\ninterface I {\n    void g();\nclass B {\n    void h() {...}\n}\n}\n}", ["class A {\n    int a;\nclass B {\n\nvoid f() { }\n\ninterface I {\n    void g();\n}\n\nvoid h() { }\n}\n}"]),
    ("r/Fields.java", "class A {\n    int x;\n    String y = \"{\";\n}\n", "class A {\n    int x;\n    String y = \"{\";\n}", ["class A {\n    int x;\n    String y = \"{\";\n}"]),
    ("r/words.java", "no code at all", "", ["no code at all"]),
    ("r/empty.py", "", "", [""]),
    ("r/long.py", "def f():\n" + "    x = 1\n" * 500, "def f(): {...}", [("def f():\n" + "    x = 1\n" * 500)[: 4 * LIMIT].rstrip()]),
    ("r/pair.py", "def f():\n" + "    x = 1\n" * 300 + "\ndef g():\n" + "    y = 2\n" * 300, "def f(): {...}\ndef g(): {...}", [("def f():\n" + "    x = 1\n" * 300).rstrip(), ("def g():\n" + "    y = 2\n" * 300).rstrip()]),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, path, text) for k, (path, text, _, _) in enumerate(CASES)], "file_id bigint, file_path string, text string")
