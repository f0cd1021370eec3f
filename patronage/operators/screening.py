"""Screening of free text for query fragments."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.scalar import BLANKS

# Words whose presence anywhere rejects a text.
KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "EXEC", "UNION",
    "WHERE", "FROM", "JOIN", "AND", "OR", "NOT", "IN", "LIKE", "BETWEEN", "IS", "NULL",
    "ORDER", "BY", "GROUP", "HAVING", "LIMIT", "OFFSET", "DISTINCT", "AS", "ON",
    "INNER", "OUTER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "CASE", "WHEN",
    "THEN", "ELSE", "END", "IF", "EXISTS", "ALL", "ANY", "SOME", "INTO", "VALUES",
    "SET", "DEFAULT", "AUTO_INCREMENT", "PRIMARY", "KEY", "FOREIGN", "REFERENCES",
    "CONSTRAINT", "INDEX", "UNIQUE", "CHECK", "TRIGGER", "PROCEDURE", "FUNCTION",
    "VIEW", "TABLE", "DATABASE", "SCHEMA", "USER", "GRANT", "REVOKE", "COMMIT",
    "ROLLBACK", "SAVEPOINT", "TRANSACTION", "LOCK", "UNLOCK", "SHOW", "DESCRIBE",
    "EXPLAIN", "ANALYZE", "OPTIMIZE", "REPAIR", "BACKUP", "RESTORE",
    "LOAD", "DUMP", "IMPORT", "EXPORT", "FLUSH", "RESET", "KILL", "SHUTDOWN",
    "START", "STOP", "RESTART", "RELOAD", "REFRESH", "CACHE", "BUFFER", "POOL",
]

# Patterns that reject a text, and the e-mail shape an accepted one has.
PATTERNS = [
    r"[;'\"\\]", r"--", r"/\*", r"\*/", r"xp_", r"sp_", r"@@", r"0x[0-9a-fA-F]+",
    r"UNION\s+ALL", r"UNION\s+SELECT", r"OR\s+1\s*=\s*1", r"AND\s+1\s*=\s*1",
    r"OR\s+'1'\s*=\s*'1'", r"AND\s+'1'\s*=\s*'1'", r"DROP\s+TABLE", r"DELETE\s+FROM",
    r"UPDATE\s+SET", r"INSERT\s+INTO", r"CREATE\s+TABLE", r"ALTER\s+TABLE",
    r"EXEC\s*\(", r"EXECUTE\s*\(", r"WAITFOR\s+DELAY", r"BENCHMARK\s*\(", r"SLEEP\s*\(",
    r"PG_SLEEP\s*\(", r"DBMS_PIPE\.RECEIVE_MESSAGE",
]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
MAX_LENGTH = 50


def shortest_words(words: list[str]) -> list[str]:
    """Words that contain no other word: a text holds one of these iff it holds any."""
    return [w for w in words if not any(o != w and o in w for o in words)]


KEYWORD_PATTERN = "|".join(shortest_words(KEYWORDS))


def _literal(pattern: str) -> str | None:
    """The plain text a pattern stands for, None if it has operators or classes."""
    if re.search(r"(?<!\\)[][(){}+*?.|^$]", pattern) or re.search(r"\\[A-Za-z]", pattern):
        return None
    return re.sub(r"\\(\W)", r"\1", pattern)


def matches_any(text: Column, upper: Column, patterns: list[str] = PATTERNS) -> Column:
    """Whether any pattern occurs, whatever the case; ``upper`` is the text in capitals.

    Plain patterns are substring tests. One that begins with a word is tried only
    on texts that hold the word, and the sign it needs, so that most texts are
    settled without walking an expression.
    """
    tests = []
    for p in patterns:
        plain = _literal(p)
        if plain is not None:
            tests.append(upper.contains(plain.upper()))
            continue
        needed = [w for w in (re.match(r"[A-Za-z0-9_]*", p).group().upper(), "=" if "=" in p else "", "(" if "\\(" in p else "") if w]
        gates = [upper.contains(w) for w in needed]
        tests.append(reduce(lambda a, b: a & b, [*gates, text.rlike("(?i)" + p)]))
    return reduce(lambda a, b: a | b, tests)


def screen_text(df: DataFrame, column: str) -> DataFrame:
    """Flags for each rule over the whole text, and the text if every rule passes."""
    # Columns of their own, so that trimming and capitals are worked out once per text.
    work = df.withColumn("_text", F.btrim(F.col(column), F.lit(BLANKS))).withColumn("_upper", F.upper("_text"))
    text, upper = F.col("_text"), F.col("_upper")
    out = work.withColumns(
        {
            "has_keyword": upper.rlike(KEYWORD_PATTERN),
            "has_pattern": matches_any(text, upper),
            "too_long": F.length(text) > MAX_LENGTH,
            "is_email": text.rlike(EMAIL),
        }
    )
    rejected = F.col("has_keyword") | F.col("has_pattern") | F.col("too_long") | ~F.col("is_email")
    out = out.withColumn("safe_text", F.when(rejected, "").otherwise(F.coalesce(text, F.lit(""))))
    return out.drop("_text", "_upper")
