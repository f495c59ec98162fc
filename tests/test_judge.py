import pytest

from sievewright.config import SearchConfig, from_environment
from sievewright.operators.judge import LexicalJudge, RateLimited, Rejected, ScriptedJudge, Transient, ask, wait_for


def run(outcomes):
    waits = []
    judge = ScriptedJudge(outcomes)
    return ask(judge, [], "m", waits.append, lambda: 0.0), waits, judge.calls


def test_good_answer():
    assert run(["yes"])[0] == ("yes", None, None, None, 1)


def test_blank_then_good():
    out, waits, calls = run(["  \n", "yes"])
    assert out[0] == "yes" and waits == [1.0] and calls == 2


def test_rate_limits():
    out, waits, calls = run([RateLimited()] * 3 + ["yes"])
    assert out[0] == "yes" and waits == [1.0, 2.0, 4.0] and calls == 4
    out, waits, calls = run([RateLimited("slow")])
    assert out[1] == "timeout" and calls == 10 and sum(waits) == 1023


def test_rejected_and_internal():
    assert run([Rejected("bad")])[0][1:] == ("request", "the request was rejected", "bad", 1)
    assert run([KeyError("x")])[0][1] == "internal"
    assert run([Transient("a"), "ok"])[0][0] == "ok"


def test_waits():
    assert [wait_for(k) for k in range(3)] == [1, 2, 4] and wait_for(0, 1.0) == 6


def test_configuration():
    assert from_environment({}).backend is None
    c = from_environment({"DEEPSEEK_API_KEY": "k", "OPENROUTER_API_KEY": "k"})
    assert c.backend.name == "deepseek" and c.input_tokens == 54_000
    assert from_environment({"GEMINI_API_KEY": "k", "DEEPSEEK_API_KEY": "k"}).backend.name == "gemini"
    with pytest.raises(ValueError):
        from_environment({"SIEVEWRIGHT_CACHE": "sometimes"})
    with pytest.raises(ValueError):
        from_environment({"DEEPSEEK_API_KEY": "k", "SIEVEWRIGHT_ANALYZE_MODEL": "other"})
    assert not SearchConfig(cache_mode="read").writes_cache and not SearchConfig(cache_mode="write").reads_cache


def test_lexical():
    j = LexicalJudge()
    ask_filter = [{"role": "system", "content": "filter\nx"}, {"role": "user", "content": "<<< a.py >>>\nclass Session\n\n<<< b.py >>>\nclass Other\n\n"}, {"role": "user", "content": "q:\n```\nwhere is the session?\n```"}]
    assert j.ask(ask_filter, "") == "a.py"
