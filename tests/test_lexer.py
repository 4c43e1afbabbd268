"""Statements cut into tokens, against a scanner written character by character."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetvitals.functions import fingerprint
from fleetvitals.functions.lexer import KEYWORDS, canonical_statement, tokens
from fleetvitals.operators import plans
from fleetvitals.operators.rollup import statement_rollup
from fleetvitals.plans import findings
from fleetvitals.sources import plan_files
from helpers import make

OPERATORS = "+-*/<>=~!@#%^&|`?"


def scanned(text: str) -> list[str]:
    """Tokens of a statement: literals as $1, keywords upper, names lower; no signs handled."""
    found, at = [], 0

    def quoted_end(start: int, mark: str, escapes: bool, doubled: bool) -> int:
        i = start
        while i < len(text):
            if escapes and text[i] == "\\":
                i += 2
            elif text[i] == mark:
                if doubled and text[i + 1:i + 2] == mark:
                    i += 2
                else:
                    return i + 1
            else:
                i += 1
        return len(text)

    def is_letter(c: str) -> bool:
        return c.isascii() and (c.isalpha() or c == "_") or c >= "\x80"

    while at < len(text):
        c, rest = text[at], text[at:]
        if c in " \t\r\n\f\v":
            at += 1
        elif rest.startswith("--"):
            while at < len(text) and text[at] not in "\r\n":
                at += 1
        elif rest.startswith("/*"):
            depth, at = 1, at + 2
            while depth and at < len(text):
                step = 2 if text[at:at + 2] in ("/*", "*/") else 1
                depth += {"/*": 1, "*/": -1}.get(text[at:at + 2], 0)
                at += step
        elif c == "$" and rest[1:2].isdigit():
            at += 1
            while at < len(text) and text[at].isdigit():
                at += 1
            found.append("$1")
        elif c == "$" and (end := rest.find("$", 1)) > 0 and (
                end == 1 or is_letter(rest[1]) and all(
                    is_letter(x) or x in "0123456789" for x in rest[1:end])):
            tag = rest[:end + 1]
            close = rest.find(tag, end + 1)
            at = len(text) if close < 0 else at + close + len(tag)
            found.append("$1")
        elif c in "eE" and rest[1:2] == "'":
            at = quoted_end(at + 2, "'", True, True)
            found.append("$1")
        elif c == "'" or c in "bBxXnN" and rest[1:2] == "'" or rest[:3] in ("u&'", "U&'"):
            at = quoted_end(at + rest.index("'") + 1, "'", False, True)
            found.append("$1")
        elif c == '"' or rest[:3] in ('u&"', 'U&"'):
            end = quoted_end(at + rest.index('"') + 1, '"', False, True)
            found.append(text[at:end])
            at = end
        elif c in "0123456789" or c == "." and rest[1:2] in tuple("0123456789"):
            i = at
            while i < len(text) and text[i] in "0123456789":
                i += 1
            if text[i:i + 1] == "." and text[i:i + 2] != "..":
                i += 1
                while i < len(text) and text[i] in "0123456789":
                    i += 1
            j = i + 1 if text[i:i + 1] in ("e", "E") else i
            if j > i:
                j += text[j:j + 1] in ("+", "-")
                if text[j:j + 1].isdigit():
                    while j < len(text) and text[j] in "0123456789":
                        j += 1
                    i = j
            at = i
            found.append("$1")
        elif is_letter(c):
            i = at
            while i < len(text) and (is_letter(text[i]) or text[i] in "0123456789$"):
                i += 1
            word = text[at:i]
            found.append(word.upper() if word.upper() in KEYWORDS else word.lower())
            at = i
        elif text[at:at + 2] in ("::", ":="):
            found.append(text[at:at + 2])
            at += 2
        elif c in OPERATORS:
            i = at
            while i < len(text) and text[i] in OPERATORS and text[i:i + 2] not in ("--", "/*"):
                i += 1
            run = text[at:i]
            while len(run) > 1 and run[-1] in "+-" and not set(run) & set("~!@#%^&|`?"):
                run = run[:-1]
            found.append(run)
            at += len(run)
        else:
            found.append(c)
            at += 1
    return found


PIECES = ["SELECT", "select", "From", "t1", "Ab_c", "é", '"a ""b\' 1"', "'x'", "'it''s'", "e'\\'-- '",
          "E'\\\\'", "$$ 'a' $$", "$q$ $$ /* $q$", "$12", "1", "2.5", ".5e-3", "7.", "1E5", "-- c 'x\n",
          "/* 'a /* n */ \" */", "/**/", "(", ")", ",", ";", ".", "=", "<=", "<>", "+", "-", "*", "/", "||",
          "::", "->>", "@>", " ", "\n", "\t", "N'é'", "x'1F'", "[", "]", "a$b", "é$1", "?", ":"]


def joined_strings(found: list[str]) -> list[str]:
    return [t for i, t in enumerate(found) if t != "$1" or i == 0 or found[i - 1] != "$1"]


def test_tokens_are_those_of_a_scanner(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += [" ".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(2000)]
    texts += ["'open 1", '"open 1', "$$open 1", "/* open 'x", "E'open\\", "$a$ open $b$ 'x'", "-- 'x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for r in rows.select("t", tokens(F.col("t")).alias("found")).collect():
        # A doubled quote ends one string token here; neighbours become one in the text.
        assert joined_strings(r.found) == joined_strings(scanned(r.t)), r.t


@pytest.mark.parametrize("texts,wanted", [
    ((r"SELECT E'x\'y'", "select 'x''y'", "SELECT $$a 1$$ -- 'q'", "/* 1 */ SELECT\n$3"), "SELECT $1"),
    (("INSERT INTO t (a,b) VALUES (1,'x'),(2,'y')", "insert into T(a, b) values (-1, $1);"),
     "INSERT INTO t(a, b) VALUES ($1)"),
    (("SELECT a-1 FROM t WHERE b IN (1,-2, +3)", "select A - 5 from t where b in ($1)"),
     "SELECT a - $1 FROM t WHERE b IN ($1)"),
    (('SELECT "col 1" FROM "T"',), 'SELECT "col 1" FROM "T"'),
    (("", " \n", "-- only", "/* a */;"), ""), ((None,), None),
])
def test_statements_written_differently_have_one_text(spark, texts, wanted):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in rows.select(canonical_statement(F.col("t"))).collect()} == {wanted}
    assert {r[0] for r in rows.select(fingerprint(F.col("t"), "all")).collect()} == {wanted}


def test_very_long_tokens_are_cut(spark):
    texts = ["SELECT '" + "a''" * 30_000 + "'", "SELECT E'" + r"\x" * 3000 + "'",
             "/*" + "*" * 30_000 + "*/ SELECT 1", "SELECT " + "$$" + "x" * 200_000 + "$$"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in rows.select(canonical_statement(F.col("t"))).collect()} == {"SELECT $1"}


# --- the server's statement ids ---


def relations_with_ids(spark):
    stmt = make(spark, "stmt", *[dict(query=f"SELECT {c} FROM big", calls=9, total_exec_time=500 + i,
                                      queryid=100 + i) for i, c in enumerate("abc")], queryid="bigint")
    plan = make(spark, "plan",
                dict(plan_id=1, line_no=1, line="Seq Scan on big", queryid=100),
                dict(plan_id=2, line_no=1, line="Sort Method: external merge  Disk: 8kB", queryid=101),
                dict(plan_id=3, line_no=1, line="Batches: 4", queryid=999),
                dict(plan_id=4, line_no=1, line="Batches: 8", queryid=None), queryid="bigint")
    return {"stmt": stmt, "plan": plan, "ext": make(spark, "ext", {})}


def test_plans_with_ids_give_findings_without_a_log(spark):
    relations = relations_with_ids(spark)
    assert {"seq_scans", "explain_spills"} <= set(findings.available(relations))
    found = findings.all_findings(relations).where(
        F.col("detector").isin("seq_scans", "explain_spills")).collect()
    assert sorted(r.detector for r in found) == ["explain_spills", "seq_scans"]
    assert [r.table_name for r in plans.sequential_scans(
        relations["stmt"], relations["plan"]).collect()] == ["big"]
    bare = {n: df.drop("queryid") for n, df in relations.items()}
    assert not {"seq_scans", "explain_spills"} & set(findings.available(bare))
    with pytest.raises(ValueError, match="need the statement log"):
        plans.sequential_scans(bare["stmt"], bare["plan"])


def test_plans_with_ids_read_no_log_and_keep_only_wanted_plans(spark, tmp_path):
    relations = relations_with_ids(spark)
    for name in ("stmt", "plan"):
        relations[name].write.parquet(f"{tmp_path}/{name}")
    make(spark, "exec", {}).write.parquet(f"{tmp_path}/exec")
    stmt, plan, log = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("stmt", "plan", "exec"))
    text = plans.sorts_on_disk(stmt, relations["ext"], plan, log)._jdf.queryExecution(
        ).optimizedPlan().toString()
    assert "sql_text" not in text and "LeftSemi" in text


def test_plan_logs_and_files_carry_ids(spark, tmp_path):
    plan = relations_with_ids(spark)["plan"]
    plan_files.write_plan_log(plan, f"{tmp_path}/log")
    back = plan_files.read_plan_log(spark, f"{tmp_path}/log", query_ids=True)
    assert sorted((r.plan_id, r.queryid) for r in back.collect()) == [(1, 100), (2, 101), (3, 999), (4, None)]
    assert "queryid" not in plan_files.read_plan_log(spark, f"{tmp_path}/log").columns
    (tmp_path / "files" / "instance=3").mkdir(parents=True)
    (tmp_path / "files" / "instance=3" / "plan=1.txt").write_text("Sort\n Query Identifier: -12\n")
    (tmp_path / "files" / "instance=3" / "plan=2.txt").write_text("Sort\n")
    rows = plan_files.read_plan_files(spark, f"{tmp_path}/files", query_ids=True).collect()
    assert {(r.plan_id, r.queryid) for r in rows} == {(1, -12), (2, None)}


def test_a_rollup_keeps_ids(spark):
    log = make(spark, "exec", dict(sql_text="SELECT 1", queryid=5), dict(sql_text="select 2", queryid=5),
               queryid="bigint")
    assert [(r.queryid, r.query, r.calls) for r in statement_rollup(log, "all").collect()] == [
        (5, "SELECT $1", 2)]
