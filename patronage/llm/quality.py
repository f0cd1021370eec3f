"""Quality rules of documents and of the hosts they come from.

Every rule is an expression over the whole text. Failures are counted per
host, each host's rate is shrunk towards the corpus by a beta prior fitted to
all hosts, and the verdict on a host goes back to its documents: in a host
that fails too often, the stricter second set of rules decides as well. A
document that breaks no rule is kept wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import CARRIED, let, set_aside, total, words_of
from patronage.session import materialize

MIN_WORDS = 50
#: Shares, in percent, above which a rule is broken: always, and in a rejected host.
REPEATED_WORDS = 50
STRICT = {"n_repeat_words": 20, "n_dup_lines": 30, "n_symbols": 10}
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = (*MEASURES, "base_failed", "strict_failed", "host_rejected", "kept")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array.

    Windows are sorted by a 64-bit hash beside their place; equal ones are
    then neighbours, so the cost is that of a sort, whatever repeats.
    """
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )
    places = let(
        F.sort_array(windows),
        lambda s: F.filter(
            F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["at"])),
            lambda at: at.isNotNull(),
        ),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda at: F.array(at, at + 1, at + 2)))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures, ``base_failed`` and ``strict_failed``; columns of these names are replaced.

    A null text measures as an empty one: no words, ``base_failed``. Lines
    count by ``\\n``; a line without a word is never a repeated one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words_of(whole), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    seen = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    out = docs.withColumns({"_words": counted, "_lines": seen}).withColumns({
        "n_words": F.col("_words.n").cast("long"),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.col("_lines.again").cast("long"),
        "n_repeat_words": F.col("_words.repeated").cast("long"),
    })
    above = lambda part, share, of: 100 * F.col(part) > share * F.col(of)
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | above("n_repeat_words", REPEATED_WORDS, "n_words"))
    strict = (
        F.col("base_failed") | above("n_repeat_words", STRICT["n_repeat_words"], "n_words")
        | above("n_dup_lines", STRICT["n_dup_lines"], "_lines.n") | above("n_symbols", STRICT["n_symbols"], "word_chars")
    )
    return out.withColumn("strict_failed", strict).drop("_words", "_lines")


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host, null being a host too: documents, failures, shrunk rate, ``host_rejected``.

    The prior is a beta distribution with the corpus mean and with the spread
    of host rates beyond what chance gives (moments over all hosts). Hosts
    that spread no more than by chance all get the corpus mean.
    """
    per = measured.groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("n_docs"), F.count_if("strict_failed").alias("n_failed")
    )
    per = materialize(per, "hosts")
    t = total(per, n=F.sum("n_docs"), failed=F.sum("n_failed"), hosts=F.count("*"))
    n, hosts = t["n"] or 0, t["hosts"]
    mean = (t["failed"] or 0) / n if n else 0.0
    noise = mean * (1 - mean)
    # Whole numbers in, so the sum does not depend on the order of hosts: sum of failed^2 / n, minus what the mean explains.
    raw = total(per, s=F.sum((F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).cast("decimal(38,9)")))["s"]
    spread = max(0.0, float(raw or 0) / n - mean * mean - noise * hosts / n) if n else 0.0
    strength = noise / spread - 1 if spread > 0 else None
    if strength is None or noise == 0:
        rate = F.lit(mean)
    else:
        rate = (F.col("n_failed") + F.lit(mean * max(strength, 0.0))) / (F.col("n_docs") + F.lit(max(strength, 0.0)))
    return per.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > limit)


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT, carry: list[str] | None = None
) -> DataFrame:
    """Add measures, ``host_rejected`` and ``kept``; one row out for each row in, repeated rows included.

    ``kept`` is false if the document fails the base rules, or if its host is
    rejected and it fails the strict ones. ``carry`` names the columns of
    ``docs`` to return (all, if not given). Documents are measured once and
    written, as hosts must be known before any verdict. An empty table gives
    an empty one. Columns named like an added one are replaced, others pass
    through, whatever their names.
    """
    inner, restore = set_aside(docs, [text, host], ADDED, carry)
    # The host goes by a name of its own, as the text need not be carried on.
    measured = measure(inner, text).withColumn("_host_of", F.col(host))
    own = [c for c in (CARRIED, *(c for c in (text, host) if carry is None or c in carry)) if c in measured.columns]
    measured = materialize(measured.select(*[f"`{c}`" for c in dict.fromkeys(own)], "_host_of", *MEASURES, "base_failed", "strict_failed"), "measured")
    hosts = host_verdicts(measured, "_host_of", limit).select("_host", "host_rejected")
    joined = measured.join(hosts, F.col("_host_of").eqNullSafe(F.col("_host")), "left")
    return restore(joined.withColumn("kept", ~(F.col("base_failed") | (F.col("host_rejected") & F.col("strict_failed")))))
