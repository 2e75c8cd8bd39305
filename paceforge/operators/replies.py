"""Audit of generated replies: citations, unsafe wording, relative dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording that a training reply must not have, and that of medical questions (fixed values).
UNSAFE = r"(?i)\b(guarantee(?:d)?|you (?:definitely|certainly) (?:can|will)|you have [a-z-]+itis|take \d+\s*(?:mg|ml))\b"
MEDICAL = r"(?i)\b(injur(?:y|ed)|pain|sick|illness|diagnos(?:e|is)|medication|chest pain|faint)\b"


def audit(replies: DataFrame) -> DataFrame:
    """Minimised audit rows of (reply_id, question, answer, cited, allowed, as_of, scheduled): the question only as hash and length.

    A reply is approved if it cites nothing beyond the allowed evidence, has no
    unsafe wording and keeps relative dates: to a question about tomorrow, a
    day without a session in ``scheduled`` (the dates of the next ones) needs
    an answer that names the date and says that nothing is scheduled. Medical
    questions are never left to a generated reply. A null question or answer is
    empty; without ``as_of`` a question about tomorrow is not grounded.
    """
    question, answer = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    unsupported = F.array_except("cited", "allowed")
    tomorrow, lowered = F.date_add("as_of", 1), F.lower(answer)
    says_gap = F.contains(answer, tomorrow.cast("string")) & F.contains(lowered, F.lit("no")) & F.contains(lowered, F.lit("scheduled"))
    grounded = ~F.contains(F.lower(question), F.lit("tomorrow")) | F.coalesce(F.array_contains("scheduled", tomorrow) | says_gap, F.lit(False))
    checked = replies.select(
        "reply_id",
        F.sha2(question.cast("binary"), 256).alias("question_sha256"),
        F.length(question).alias("question_length"),
        F.size(unsupported).alias("unsupported"),
        answer.rlike(UNSAFE).alias("unsafe"),
        question.rlike(MEDICAL).alias("medical"),
        grounded.alias("grounded"),
    )
    return checked.withColumn("outcome", F.when(F.col("medical"), "medical").when((F.col("unsupported") == 0) & ~F.col("unsafe") & F.col("grounded"), "approved").otherwise("fallback"))
