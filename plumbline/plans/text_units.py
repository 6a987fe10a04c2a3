"""Source units and statements made from `orders`, in Spark and in SQL: texts with one construct each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, spread, table

TEXTS = (
    "create or replace function f# return sys_refcursor is begin insert into audit.log values (#); end;",
    "create procedure p# is begin x := 1; exception when others then null; end;",
    "create procedure p# is begin run; exception when no_data_found then log_pkg.write(sqlerrm); when others then rollback; end;",
    "begin for r in (select id from t#) loop update t# set x = 1; end loop; end;",
    "begin for r in c_items loop null; end loop; dbms_output.put_line('#'); end;",
    "begin v_password := 'tiger#'; log_pkg.info('no token here'); end;",
    "create package p# authid   CURRENT_USER as procedure q; end;",
    "begin select a bulk collect into l from t#; select b bulk collect into m from t# where limit = 10; trace(1); end;",
    "begin dbms_job.submit(#); select 1 from a, b where a.id = b.id(+); commit work; end;",
    "create function d# return date deterministic is begin return sysdate; end;",
    "create trigger g# before update on emp# for each row begin select count(*) into n from emp#; end;",
    "create public synonym pay# for hr.salary_#",
    "create unique index i# on emp# (a, b); select 1 from emp# where a is null and c is null",
    "begin execute immediate 'select ' || v_col || ' from dual'; end;",
    "begin execute immediate 'drop table ' || dbms_assert.simple_sql_name(v); end;",
    "begin dbms_sql.parse(c, 'x#'); end;",
    "begin open c for v_sql; end;",
    "begin execute immediate 'truncate table t#'; end;",
    "begin delete from app.orders#; merge into hr.emp using t on (1 = 1); insert into t@far_# values ('it''s: insert into hr.x'); end;",
    "begin null; end;",
)
STATEMENTS = (
    "SELECT a.x FROM t1 a JOIN app.t2 b ON a.id = b.id WHERE a.y = '#'",
    "INSERT INTO t3 SELECT * FROM t4 JOIN t5 ON 1 = 1",
    "UPDATE t6 SET a = # WHERE b IN (SELECT b FROM t7)",
    "DELETE FROM t8 WHERE id = #",
    "MERGE INTO t9 USING t10 ON (t9.id = t10.id)",
    "/* note # */ WITH q AS (SELECT 1 FROM dual) SELECT * FROM q",
    "BEGIN run_everything_with_a_rather_long_name(#, 'and a rather long text that goes on and on'); END;",
)


def _case(texts: tuple):
    out = None
    for i, t in enumerate(texts):
        v = F.replace(F.lit(t), F.lit("#"), F.col("o_orderkey").cast("string"))
        c = F.col("o_orderkey") % len(texts) == i
        out = F.when(c, v) if out is None else out.when(c, v)
    return out


def _sql_case(texts: tuple) -> str:
    rows = " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(texts))
    return f"replace(CASE o_orderkey % {len(texts)} {rows} END, '#', o_orderkey::VARCHAR)"


def units(spark: SparkSession, d: str) -> DataFrame:
    # written, as real sources are: the expressions of scanners would each repeat the whole CASE
    return cut(spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(F.concat(F.lit("app.u"), "o_orderkey").alias("unit"), _case(TEXTS).alias("text")))


def statements(spark: SparkSession, d: str) -> DataFrame:
    return cut(spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("stmt_id"), _case(STATEMENTS).alias("sql")))


LOW = "lower(text) AS low, regexp_replace(lower(text), '''(?:[^'']|'''')*''', '''''', 'g') AS m"
UNITS_SQL = f"u AS (SELECT unit, text, {LOW} FROM (SELECT 'app.u' || o_orderkey AS unit, {_sql_case(TEXTS)} AS text FROM orders)), v AS (SELECT *, regexp_replace(m, '\\s+', ' ', 'g') AS c FROM u)"
STATEMENTS_SQL = f"s AS (SELECT o_orderkey AS stmt_id, {_sql_case(STATEMENTS)} AS sql FROM orders)"
