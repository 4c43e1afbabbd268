"""Statements read token by token, from left to right, as column expressions.

One pattern with an alternative per kind of token cuts a text without gaps, so a quote
inside a comment, a comment mark inside a string or a digit inside a quoted name is
never taken for what it is not. What is left of a statement is its canonical text:
comments and layout go, literals and parameters become ``$1``, keywords stand in upper
case, other unquoted names in lower case (the server folds them), quoted names as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of tokens (fixed values of the server's lexical rules). Block comments nest, here
# to a depth of three; a string, name or comment without an end reaches to the end of the
# text. Loops run over the rare characters only, as the matcher's stack grows with them.
_IN_COMMENT = r"[^*/]*+(?:(?:\*+(?!/)|/(?!\*){0})[^*/]*+)*+"
_COMMENT_1 = r"/\*" + _IN_COMMENT.replace("{0}", "") + r"\*/"
_COMMENT_2 = r"/\*" + _IN_COMMENT.replace("{0}", "|" + _COMMENT_1) + r"\*/"
_COMMENT_3 = r"/\*" + _IN_COMMENT.replace("{0}", "|" + _COMMENT_2) + r"(?:\*/|\z)"
COMMENT = rf"--[^\r\n]*+|{_COMMENT_3}|/\*(?s:.*)"
_LETTER = r"A-Za-z_\x{80}-\x{10FFFF}"
DOLLAR_STRING = rf"\$([{_LETTER}][{_LETTER}0-9]*+)?\$(?s:.*?)(?:\$\1\$|\z)"
UNTAGGED_STRING = r"\$\$(?s:.*?)(?:\$\$|\z)"
ESCAPE_STRING = r"[eE]'[^'\\]*+(?:(?:\\(?s:.)|'')[^'\\]*+)*+(?:'|\\?\z)"
# A doubled quote ends one string and begins the next; neighbours are joined below.
STRING = r"(?:[uU]&|[bBxXnN])?'[^']*+(?:'|\z)"
QUOTED_NAME = r'(?:[uU]&)?"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
NUMBER = (r"0[xX][0-9A-Fa-f_]+|0[oO][0-7_]+|0[bB][01_]+"
          r"|(?:[0-9][0-9_]*+(?:\.(?!\.)[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]+)?")
PARAMETER = r"\$[0-9]+"
NAME = rf"[{_LETTER}][{_LETTER}0-9$]*+"
CAST = r"::|:="
# An operator ends before a comment, and in a sign only if it holds one of the second set.
_PLAIN, _SPECIAL = r"(?:(?!--|/\*)[+\-*/<>=])", "[~!@#%^&|`?]"
OPERATOR = (rf"(?={_PLAIN}*{_SPECIAL})(?:{_PLAIN}|{_SPECIAL})+"
            rf"|{_PLAIN}*(?!/\*)[*/<>=]|[+\-]")
TOKEN = "|".join((
    COMMENT, PARAMETER, UNTAGGED_STRING, DOLLAR_STRING, ESCAPE_STRING, STRING, QUOTED_NAME,
    NUMBER, NAME, CAST, OPERATOR, r"\S"))
LITERAL_START = r"^(?:[eEbBxXnN]?'|[uU]&'|\$.|[0-9]|\.[0-9])"
COMMENT_START = r"^(?:--|/\*)"
NAME_START = rf"^[{_LETTER}]"
OPERAND_END = r"^(?:\$1|\)|\]|.*\")$"

# Words that are never a table, column or function of their own (fixed values).
KEYWORDS = tuple("""
ALL ANALYZE AND ANY ARRAY AS ASC BEGIN BETWEEN BY CASE CAST COMMIT CREATE CROSS DELETE DESC DISTINCT
DO DROP ELSE END EXCEPT EXECUTE EXISTS EXPLAIN FALSE FETCH FOR FROM FULL GROUP HAVING ILIKE IN INNER
INSERT INTERSECT INTO IS ISNULL JOIN LATERAL LEFT LIKE LIMIT NATURAL NOT NOTNULL NULL OFFSET ON OR
ORDER OUTER OVER PARTITION RETURNING RIGHT ROLLBACK SELECT SET SIMILAR SOME TABLE THEN TO TRUE
UNION UPDATE USING VALUES WHEN WHERE WINDOW WITH""".split())
PARAMETER_MARK = "$1"
LITERALS_IN_A_ROW = r"\$1(?: \$1)+"
LITERAL_LIST = r"\(\$1(?:, \$1)+\)"
ROW_LIST = r"\(\$1\)(?:, \(\$1\))+"


def tokens(sql_text: Column) -> Column:
    """The tokens of a statement without comments, each in its canonical form."""
    found = F.filter(F.regexp_extract_all(sql_text, F.lit(TOKEN), F.lit(0)),
                     lambda t: ~t.rlike(COMMENT_START))

    def canonical(token: Column) -> Column:
        upper = F.upper(token)
        return (F.when(token.rlike(LITERAL_START), F.lit(PARAMETER_MARK))
                .when(upper.isin(*KEYWORDS), upper)
                .when(token.rlike(NAME_START) & ~token.endswith('"'), F.lower(token))
                .otherwise(token))

    return F.transform(found, canonical)


def _unsigned(found: Column) -> Column:
    """Tokens without the signs of literals: a sign after what is no operand."""
    def stays(token: Column, at: Column) -> Column:
        before = F.get(found, at - 1)
        operand = before.rlike(OPERAND_END) | (
            before.rlike(NAME_START) & ~before.isin(*KEYWORDS))
        sign = token.isin("-", "+") & (F.get(found, at + 1) == PARAMETER_MARK)
        return ~sign | F.coalesce(operand, F.lit(False))

    return F.filter(found, stays)


def _joined(found: Column) -> Column:
    """The tokens as one text, spaced the same however they were written."""
    def spaced(token: Column, at: Column) -> Column:
        before = F.get(found, at - 1)
        called = (token == "(") & before.rlike(rf'^["{_LETTER}]') & ~before.isin(*KEYWORDS)
        tight = (before.isNull() | token.isin(",", ")", ".", ";", "::", "[", "]")
                 | before.isin("(", ".", "::", "[") | called)
        return F.when(tight, token).otherwise(F.concat(F.lit(" "), token))

    return F.array_join(F.transform(found, spaced), "")


def canonical_statement(sql_text: Column) -> Column:
    """The canonical text of a statement; lists of literals and rows of them become one.

    Null stays null; a text of comments and blanks only, and an empty one, is empty.
    """
    # One-element arrays let each step be computed once.
    cut = F.transform(F.array(tokens(sql_text)), _unsigned)
    text = F.transform(cut, _joined)[0]
    for pattern, one in ((LITERALS_IN_A_ROW, r"\$1"), (LITERAL_LIST, r"(\$1)"),
                         (ROW_LIST, r"(\$1)"), (r"[\s;]+$", "")):
        text = F.regexp_replace(text, pattern, one)
    return text
