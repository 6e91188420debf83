import re

import pytest

from quillmill.llm import rule_ledger as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000)) + " " + " ".join(f"w{i}" for i in range(15_000))
TEXTS = [
    None, "", "   \n\t", "one", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n\n \nx", "a # b | $ <c> &%*",
    "naïve ÉCOLE ü x", "\x0ba b\x0c", "a b c d a b c e b c d", LONG, "l1 l2 l3\n" * 40, "WORD!! " * 60,
]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_measurements_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    led = L.apply_policy(L.ledger(df), L.STANDARD)
    rows = led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "kept").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute(TEXTS[r.doc_id])
        assert tuple(r)[1:6] == want, r.doc_id
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert bool(r.fail_bits & L.BASE.mask(L.RULES)) == failed
        assert not (failed and r.kept)


def test_policies_and_ablations_need_no_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    led = L.ledger(df).select("doc_id", "fail_bits").cache()
    loose = L.Policy("loose-1", ("few_words",))
    kept = {r.doc_id for r in L.apply_policy(led, loose).where("kept").collect()}
    assert kept == {r.doc_id for r in led.collect() if not r.fail_bits & 1}
    rows = {r.rule: r for r in L.ablations(led, L.STANDARD).collect()}
    bits = [r.fail_bits for r in led.collect()]
    for rule in L.RULES:
        hit = [b for b in bits if b >> rule.bit & 1]
        if hit:
            assert rows[rule.name].n_failed == len(hit)
            assert rows[rule.name].n_failed_alone == sum(b == 1 << rule.bit for b in hit)
            want = 0
            for b in hit:
                want |= b
            assert rows[rule.name].fails_with == want


def test_ties_repeats_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 5, 7), (1, "a b", 5, 7)], "doc_id long, text string, n_words int, fail_bits int")
    out = L.ledger(df)
    assert [r.n_words for r in out.collect()] == [2, 2]
    assert out.columns.count("n_words") == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.apply_policy(L.ledger(empty), L.BASE).count() == 0


@pytest.mark.parametrize("name", [r.name for r in L.RULES])
def test_each_rule_has_its_own_bit(name):
    assert L.Policy("x", (name,)).mask(L.RULES).bit_count() == 1
