"""Quality rules: a ledger of rule failure bits.

Each rule is measured once per document; the ledger row holds the
measurements and one failure bit per rule. Policies are versioned masks over
those bits, so a new policy or an ablation never reads the texts again.
Built from DataFrame functions only.

Defined results: a null, empty or blank text has no words and zero
measurements (it fails ``few_words``); rows are judged one by one, so ties and
repeated rows keep their own rows; an empty table gives an empty ledger;
columns of the input that clash with a ledger column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import words


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurement columns; ``bit`` its place in the mask."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is kept if none of these rules failed."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > n_words"),
    Rule(3, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    Rule(4, "repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    Rule(5, "few_distinct_words", "n_words >= 50 and 10 * n_distinct_words < n_words"),
    Rule(6, "capitals", "n_letters >= 50 and 10 * n_upper > 7 * n_letters"),
    Rule(7, "exclamations", "n_words > 0 and 2 * n_exclaim > n_words"),
    Rule(8, "many_words", "n_words > 10000000"),
)
BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hash; (hash, place) pairs are sorted so that
    equal windows meet, n log n in the words of one text. Texts without a
    repeated window, by far the most, stop at one hash-set pass.
    """
    n = F.size(ws)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)),
    )

    def covered(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            dup = F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(dup, lambda x: x["i"]))

        def span(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
                lambda a, i: F.struct(
                    (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")
                ),
                lambda a: a["n"],
            )

        # transform over a one-element array names a value, so it is computed once
        found = F.transform(F.transform(F.array(pairs), places), span)
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(found[0])

    return F.when(n < 4, F.lit(0)).otherwise(F.transform(F.array(windows), covered)[0]).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurement columns; the text itself may then be dropped."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_ws", words(F.col(text))).withColumn(
        "_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    )
    size = lambda c: F.length(c).cast("long")
    return out.withColumns(
        {
            "n_words": F.size("_ws").cast("long"),
            "word_chars": size(F.array_join("_ws", "")),
            "n_symbols": size(t) - size(F.translate(t, "#*$%&|<>", "")),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_ws")),
            "n_lines": F.size("_lines").cast("long"),
            "n_distinct_words": F.size(F.array_distinct("_ws")).cast("long"),
            "n_letters": size(F.regexp_replace(t, r"[^\p{L}]+", "")),
            "n_upper": size(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
            "n_exclaim": size(t) - size(F.translate(t, "!", "")),
        }
    ).drop("_ws", "_lines")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its columns, the measurements and ``fail_bits``."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(docs, text).withColumn("fail_bits", mask)


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, out: str = "kept") -> DataFrame:
    """Adds the verdict of a policy and its version, from the bits alone."""
    return led.withColumns(
        {
            out: F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0,
            f"{out}_policy": F.lit(policy.version),
        }
    )


def ablations(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does, by aggregation over the bits.

    Per rule: documents that fail it, that fail it alone (they come back if the
    rule goes), and the bits that ever fail together with it (``bit_or``).
    """
    mask = policy.mask(rules)
    seen = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    patterns = led.select(seen.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    table = led.sparkSession.createDataFrame(
        [(r.name, 1 << r.bit) for r in rules if r.name in policy.rules], "rule string, bit long"
    )
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    # at most 2^rules patterns against the rules of a policy: both sides are of fixed size
    return (
        patterns.join(F.broadcast(table), hit)
        .groupBy("rule")
        .agg(
            F.sum("n").alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.bit_or("bits").alias("fails_with"),
        )
    )
