"""Evidence of a test case: its own body, hooks in scope, then declarations one and two imports away, within budgets of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import running_sums
from .evidence import cut_text, line_cut

# What a hop's number stands for.
REASONS = ("test-body", "hook-in-scope", "hop-1", "hop-2")


def selected_evidence(candidates: DataFrame, fragment_most: int, bundle_most: int) -> DataFrame:
    """candidates(case_id, hop, path, start, stop, text) -> the same without text and repeats, with reason, action, bytes, truncated and content.

    Hop 0 is the body, 1 hooks in order of the source, 2 and 3 what is imported by the test and by its helpers, by path
    and place; of one span the nearer hop counts, but a body and hooks are taken as they are. Each fragment is cut to its
    own budget: to the last line that fits, or to a whole character. Then a case's budget is filled in order: the first
    fragment that doesn't fit is cut at a line's end, or left out where not one line fits, and all later ones are left out.
    The running sums are those of ranges of rows, so a case with very many candidates is spread over tasks."""
    near = F.when(F.col("hop") >= 2, 2).otherwise(F.col("hop"))
    spans = candidates.groupBy("case_id", near.alias("kind"), "path", "start", "stop").agg(F.min(F.struct("hop", "text")).alias("x")).select("case_id", "path", "start", "stop", "x.*")
    cut = spans.withColumn("content", cut_text(F.col("text"), fragment_most)).withColumn("n", F.octet_length("content").cast("long"))
    # hooks stand in order of the source, imports by path first
    by_path = F.when(F.col("hop") >= 2, F.col("path")).otherwise("")
    summed = running_sums(cut.withColumn("by_path", by_path), "case_id", ["hop", "by_path", "start", "stop", "path"], "n")
    rest = F.lit(bundle_most) - (F.col("sum") - F.col("n"))
    kept, first = F.col("sum") <= bundle_most, rest >= 0
    part = F.when(first & ~kept, line_cut(F.col("content"), rest)).otherwise(F.lit(0).cast("long"))
    rows = summed.withColumn("part", part)
    action = F.when(kept, "keep").when(F.col("part") > 0, "cut").otherwise("omit")
    size = F.when(kept, F.col("n")).otherwise(F.col("part"))
    content = F.when(kept, F.col("content")).when(F.col("part") > 0, F.decode(F.substr(F.col("content").cast("binary"), F.lit(1), F.col("part").cast("int")), "UTF-8"))
    truncated = (F.octet_length("text") > F.col("n")) | (action == "cut")
    reason = F.element_at(F.array(*[F.lit(x) for x in REASONS]), F.col("hop") + 1)
    return rows.select("case_id", "hop", "path", "start", "stop", reason.alias("reason"), action.alias("action"), size.alias("bytes"), F.when(action != "omit", truncated).otherwise(F.lit(False)).alias("truncated"), content.alias("content"))
