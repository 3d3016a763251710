"""Backup and rollback SQL for each statement, with a safety class; templates are Column expressions.

Numbers of statements and of backup tables run over the whole corpus in file and line order. They come from counts in each
file's own row and a running sum over files: files are ranged by path over tasks, each range is summed by itself, and only the
totals of the ranges are summed in one place. Statements are only ordered within their file.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from plumbline.functions.lexer import values_tuples
from plumbline.operators.parse import shuffled


@dataclass(frozen=True)
class Options:
    dialect: str = "mysql"  # or postgresql, gaussdb
    date: str = "20240101"  # yyyymmdd in backup names
    prefix: str = "bks_"
    backup_mode: str = "auto"
    lock_scope: str = "auto"
    coalesce_mode: str = "conservative"
    primary_keys: tuple[tuple[str, tuple[str, ...]], ...] = ()
    allow_partial: bool = False
    fail_on_warning: bool = False
    wrap_transaction: bool = True
    replace_kind: bool = False  # REPLACE is a kind of its own, not an INSERT

    @property
    def mysql(self) -> bool:
        return self.dialect == "mysql"


def clean(name: str) -> str:
    """Expression: a name without quotes; names all in upper case are folded to lower case."""
    bare = f"regexp_replace({name}, '[`\"]', '')"
    return f"if({bare} = upper({bare}) and {bare} rlike '[A-Z]', lower({bare}), {bare})"


def quoted(x: str, o: Options) -> str:
    return f"concat('`', replace({x}, '`', '``'), '`')" if o.mysql else f"concat('\"', replace({x}, '\"', '\"\"'), '\"')"


def target(o: Options | None = None) -> str:
    """Expression of the statement's table: the first payload that has one."""
    return clean("coalesce(s.create_table.table_name, s.drop.name, s.alter.table_name, s.insert.table_name, s.update.table_name, s.delete.table_name, s.truncate.table_name, s.create_index.table_name, s.view.name, '')")


_LIKE_PG = "(LIKE {x} INCLUDING DEFAULTS INCLUDING CONSTRAINTS INCLUDING INDEXES INCLUDING COMMENTS INCLUDING GENERATED)"


def fill(template: str, **parts: str) -> str:
    """SQL concat of a template with {name} places."""
    out, rest = [], template
    lit = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += ([lit(before)] if before else []) + [parts[name]]
    return f"concat({', '.join(out + ([lit(rest)] if rest else []))})"


def _templates(o: Options) -> dict[str, str]:
    t, b, sh, old = quoted("tbl", o), quoted("bks", o), quoted("shadow", o), quoted("concat(tbl, '_old_', lpad(cast(seq as string), 4, '0'))", o)
    where = "if(coalesce(w, '') = '', '', concat(' WHERE ', w))"
    escaped = "replace(tbl, '\\'', '\\'\\'')" if not o.mysql else "replace(tbl, '\\'', '\\\\\\\\\\'')"
    p = {"t": t, "b": b, "sh": sh, "old": old, "w": where, "e": escaped, "n": quoted("'check_table_exists'", o), "c": quoted("'check_row_count'", o), "p": quoted("'check_partition'", o)}
    like = lambda x: "LIKE {" + x + "}" if o.mysql else _LIKE_PG.replace("{x}", "{" + x + "}")
    lock = ("FLUSH TABLES WITH READ LOCK;\n", "UNLOCK TABLES;\n") if o.mysql else ("LOCK TABLE {t} IN ACCESS SHARE MODE;\n", "")
    backup = lock[0] + "DROP TABLE IF EXISTS {b};\nCREATE TABLE {b} " + like("t") + ";\nINSERT INTO {b} SELECT * FROM {t}@;\n" + lock[1]
    off, on = ("SET FOREIGN_KEY_CHECKS=0;\n", "SET FOREIGN_KEY_CHECKS=1;\n") if o.mysql else ("", "")
    exists = "SELECT IF(EXISTS(\n  SELECT 1 FROM information_schema.tables\n  WHERE table_schema=DATABASE() AND table_name='{e}'\n), 1, 0) AS {n};\n" if o.mysql else "SELECT EXISTS(\n  SELECT 1 FROM information_schema.tables\n  WHERE table_schema=current_schema() AND table_name='{e}'\n) AS {n};\n"
    part = "SELECT partition_method AS {p}\nFROM information_schema.partitions\nWHERE table_schema=DATABASE() AND table_name='{e}';\n" if o.mysql else "SELECT partition_strategy AS {p}\nFROM pg_partitions\nWHERE schemaname=current_schema() AND tablename='{e}';\n"
    rename = "-- atomic switch: the table is kept as its _old copy\n" + off + "DROP TABLE IF EXISTS {old};\nDROP TABLE IF EXISTS {sh};\nCREATE TABLE {sh} LIKE {b};\nINSERT INTO {sh} SELECT * FROM {b};\nRENAME TABLE {t} TO {old}, {sh} TO {t};\n" + on + "-- after a check, cleanup drops {old}\n"
    transactional = "-- inside a transaction\nDROP TABLE IF EXISTS {t};\nCREATE TABLE {t} " + like("b") + ";\nINSERT INTO {t} SELECT * FROM {b};\n"
    rebuild = "-- rebuilt from the backup\n" + off + "CREATE TABLE {t} " + like("b") + ";\nINSERT INTO {t} SELECT * FROM {b};\n" + on
    return {
        "backup_full": fill(backup.replace("@", ""), **p), "backup_where": fill(backup.replace("@", "{w}"), **p), "schema_check": fill("-- schema check: table exists\n" + exists + "-- schema check: row count\nSELECT COUNT(*) AS {c} FROM {t};\n", **p),
        "partition_check": fill("-- partition check: rows mean a partitioned table\n" + part, **p), "restructure": fill(rename if o.mysql else transactional, **p), "rebuild": fill(rebuild, **p),
        "view_backup": fill("CREATE VIEW {b} AS SELECT * FROM {t};", **p), "view_rollback": fill("CREATE OR REPLACE VIEW {t} AS SELECT * FROM {b};", **p),
        "reinsert": fill("INSERT INTO {t} SELECT * FROM {b};", **p), "drop_table": fill("DROP TABLE IF EXISTS {t};", **p),
        "drop_view": fill("DROP VIEW IF EXISTS {t};", **p), "drop_index": fill("DROP INDEX IF EXISTS {i} ON {t};" if o.mysql else "DROP INDEX IF EXISTS {i};", t=t, i=quoted(clean("s.create_index.name"), o)),
    }


def _alter_inverse(o: Options) -> str:
    """Array of inverse statements of metadata-only ALTER operations (null where there is none)."""
    t, col = quoted("tbl", o), quoted(clean("x.column_name"), o)
    con, new = quoted(clean("x.constraint_name"), o), quoted(clean("regexp_extract(x.detail, '(?i)\\\\bTO (.+)$', 1)"), o)
    pk = fill("ALTER TABLE {t} DROP PRIMARY KEY;" if o.mysql else "ALTER TABLE {t} DROP CONSTRAINT {k};", t=t, k=f"if(x.constraint_name <> '', {con}, {quoted(chr(99) + 'oncat(tbl, ' + chr(39) + '_pkey' + chr(39) + ')', o)})")
    up = "upper(x.detail)"
    rename = fill("RENAME TABLE {a} TO {t};" if o.mysql else "ALTER TABLE {a} RENAME TO {t};", a=quoted(clean("x.table_name"), o), t=t)
    return (
        "transform(s.alter.ops, x -> case x.operation_type "
        f"when 'ADD_COLUMN' then {fill('ALTER TABLE {t} DROP COLUMN {c};', t=t, c=col)} "
        f"when 'ADD_CONSTRAINT' then case when contains({up}, 'PRIMARY KEY') then {pk} when contains({up}, 'FOREIGN KEY') or contains({up}, 'CHECK') then {fill('ALTER TABLE {t} DROP CONSTRAINT {c};', t=t, c=con)} "
        f"when x.constraint_name <> '' then {fill('ALTER TABLE {t} DROP INDEX {c};', t=t, c=con)} end "
        f"when 'RENAME_COLUMN' then {fill('ALTER TABLE {t} RENAME COLUMN {n} TO {c};', t=t, n=new, c=col)} when 'RENAME_TABLE' then {rename} end)"
    )


_CONSTRAINED = "upper(x.detail) rlike 'NOT NULL|DEFAULT|COMMENT|ON UPDATE|AUTO_INCREMENT|UNIQUE|PRIMARY KEY|REFERENCES|CHECK'"
_METADATA = f"(s.kind = 'ALTER_TABLE' and forall(s.alter.ops, x -> case x.operation_type when 'ADD_COLUMN' then not ({_CONSTRAINED}) else x.operation_type in ('ADD_CONSTRAINT', 'RENAME_COLUMN', 'RENAME_TABLE') end))"
_DDL = "('CREATE_TABLE', 'DROP_TABLE', 'ALTER_TABLE', 'CREATE_INDEX', 'DROP_INDEX', 'CREATE_VIEW', 'DROP_VIEW', 'RENAME_TABLE', 'TRUNCATE')"
_SKIPPED = "('START_TRANSACTION', 'COMMIT', 'ROLLBACK', 'SET_VARIABLE', 'USE')"
_FULL = f"(s.kind in ('DROP_TABLE', 'DROP_INDEX', 'DROP_VIEW') or (s.kind = 'ALTER_TABLE' and not {_METADATA}))"


def _insert_udf(o: Options):
    mark = "`" if o.mysql else '"'
    quote = lambda n: mark + n.replace(mark, mark * 2) + mark

    @F.pandas_udf("struct<rollback:string,reliable:boolean,warning:string>")
    def deletes(sql: pd.Series, table: pd.Series, columns: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, name, cols, pk in zip(sql, table, columns, keys, strict=True):
            if name is None or text is None:
                rows.append((None, None, None))
                continue
            cols = [c.strip('`"') for c in (cols if cols is not None else [])]
            pk = list(pk) if pk is not None else []
            tuples = values_tuples(text)
            at = [next((i for i, c in enumerate(cols) if c.lower() == k.lower()), None) for k in pk]
            at = [i for i in at if i is not None]
            pairs = list(zip(pk, at, strict=False)) if at else list(zip(cols, range(len(cols)), strict=True))
            out = []
            for values in tuples:
                cond = [f"{quote(c)} = {values[i]}" for c, i in pairs if i < len(values) and (at or values[i].upper() != "DEFAULT")]
                if cond:
                    out.append(f"DELETE FROM {quote(name)} WHERE {' AND '.join(cond)};")
            if not tuples:
                rows.append((None, False, "VALUES extraction failed, rollback not generated"))
            elif not pk:
                rows.append(("\n".join(out), False, "no primary key, fallback to full-column match"))
            elif not at:
                rows.append(("\n".join(out), False, "PK column not in INSERT columns, fallback to full-column match"))
            else:
                rows.append(("\n".join(out), True, None))
        return pd.DataFrame(rows, columns=["rollback", "reliable", "warning"])

    return deletes


def _replace_udf(o: Options):
    mark = "`" if o.mysql else '"'

    @F.pandas_udf("struct<filter:string,warning:string>")
    def rows_by_key(sql: pd.Series, columns: pd.Series, keys: pd.Series) -> pd.DataFrame:
        """The old rows that a REPLACE overwrites, by the values of its one key column; else all rows of the table."""

        def one(text, cols, pk):
            if text is None:
                return None, None
            tuples = values_tuples(text)
            if not tuples:
                return None, "VALUES extraction failed, full table backup"
            if pk is None or not len(pk):
                return None, "no primary key, full table backup"
            if len(pk) > 1:
                return None, "composite PK not supported for REPLACE incremental backup, full table backup"
            at = next((i for i, c in enumerate(cols if cols is not None else []) if c.strip('`"').lower() == pk[0].lower()), None)
            if at is None:
                return None, "PK column not in REPLACE columns, full table backup"
            values = [t[at] for t in tuples if at < len(t)]
            if not values:
                return None, "PK value extraction failed, full table backup"
            return f"{mark}{pk[0].replace(mark, mark * 2)}{mark} IN ({', '.join(values)})", None

        return pd.DataFrame([one(*x) for x in zip(sql, columns, keys, strict=True)], columns=["filter", "warning"])

    return rows_by_key


def _kept(rows: DataFrame) -> DataFrame:
    """rows, computed once: in the checkpoint folder if there is one, else held by the executors."""
    if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return rows.checkpoint()
    return rows.persist(StorageLevel.DISK_ONLY)


def running(files: DataFrame, columns: list[str]) -> DataFrame:
    """files (file_path, counts..), one row a file -> file_path and for each count the sum over all files before it (`<count>_before`)."""
    counted = _kept(files)  # ranging reads its input twice, and that is a parse
    ranged = _kept(counted.repartitionByRange("file_path").withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = totals.select("_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in columns])
    own = Window.partitionBy("_range").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("file_path", "_range", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(c) for c in columns])
    return summed.join(F.broadcast(base), "_range").select("file_path", *[(F.col(c) + F.col(f"_{c}")).alias(f"{c}_before") for c in columns])


def _conditions(o: Options) -> tuple[str, str, str]:
    """Expressions: statement `s` is a REPLACE of its own kind, gets a full backup, gets any backup."""
    replaces = "(s.kind = 'INSERT' and s.insert.replace)" if o.replace_kind else "false"
    full = f"({_FULL} and not ('{o.backup_mode}' = 'incremental' and s.kind = 'ALTER_TABLE'))"
    return replaces, full, f"({full} or s.kind in ('UPDATE', 'DELETE', 'TRUNCATE') or {replaces})"


def numbers(asts: DataFrame, o: Options = Options()) -> DataFrame:
    """(file_path, n_before, b_before): statements and backups in all files before it. The dialect does not matter, so several can share them."""
    _, _, backed_up = _conditions(o)
    counts = asts.select("file_path", F.expr("cast(size(ast.statements) as bigint)").alias("n"), F.expr(f"cast(size(filter(ast.statements, s -> {backed_up})) as bigint)").alias("b"))
    return running(counts, ["n", "b"])


def pairs(asts: DataFrame, o: Options = Options(), before: DataFrame | None = None) -> DataFrame:
    """One row a statement: backup and rollback SQL, safety flags, review level, lock type and warnings. Paths of files are unique.

    `before`: the `numbers` of these files, if they are there already.
    """
    replaces, full, backed_up = _conditions(o)
    before = numbers(asts, o) if before is None else before
    rows = asts.select("file_path", F.expr("ast.statements").alias("statements")).join(shuffled(before), "file_path").select("file_path", "n_before", "b_before", F.posexplode("statements").alias("stmt_index", "s"))
    has_backup = F.expr(backed_up)
    own = Window.partitionBy("file_path").orderBy("stmt_index")
    rows = rows.withColumn("seq", F.col("n_before") + F.col("stmt_index") + 1).withColumn("backup_seq", F.when(has_backup, F.col("b_before") + F.sum(has_backup.cast("long")).over(own)))
    safe = "regexp_replace(tbl, '[^A-Za-z0-9_]', '_')"
    rows = rows.withColumn("tbl", F.expr(target())).withColumn("w", F.expr("coalesce(s.update.where_clause, s.delete.where_clause)"))
    rows = rows.withColumn("bks", F.expr(f"concat('{o.prefix}', {safe}, '_{o.date}_', lpad(cast(backup_seq as string), greatest(4, length(cast(backup_seq as string))), '0'))"))
    rows = rows.withColumn("shadow", F.expr(f"concat('_rb_', lpad(cast(seq as string), greatest(4, length(cast(seq as string))), '0'), '_', {safe})"))
    keys = {t.lower(): list(c) for t, c in o.primary_keys}
    pk = F.expr("cast(null as array<string>)")
    for t, cols in keys.items():
        pk = F.when(F.lower("tbl") == t, F.array(*[F.lit(c) for c in cols])).otherwise(pk)
    rows = rows.withColumn("pk", pk)
    ins = _insert_udf(o)(F.expr("s.stmt_text"), F.expr("if(s.kind = 'INSERT', tbl, null)"), F.expr("s.insert.columns"), F.col("pk"))
    if o.replace_kind:
        rows = rows.withColumn("rep", _replace_udf(o)(F.expr(f"if({replaces}, s.stmt_text, null)"), F.expr("s.insert.columns"), F.col("pk")))
        rows = rows.withColumn("w", F.when(F.expr(replaces), F.col("rep.filter")).otherwise(F.col("w")))
    rows = rows.withColumn("ins", ins)
    t, b = quoted("tbl", o), quoted("bks", o)
    col = quoted("c", o)
    same = f"concat({t}, '.', {col}, ' = ', {b}, '.', {col})"
    nulls = f"concat('(', {same}, ' OR (', {t}, '.', {col}, ' IS NULL AND ', {b}, '.', {col}, ' IS NULL))')"
    join = f"if(size(pk) > 0, array_join(transform(pk, c -> {same}), ' AND '), array_join(transform(s.update.set_columns, c -> {nulls}), ' AND '))"
    update = f"concat('UPDATE ', {t}, ' JOIN ', {b}, ' ON ', {join}, '\\nSET ', array_join(transform(s.update.set_columns, c -> {same}), ', '), ';')"
    m = _templates(o)
    structural = f"if(s.kind = 'DROP_TABLE', {m['rebuild']}, {m['restructure']})"
    view = "s.kind = 'DROP_VIEW'"
    backup = F.expr(f"case when {full} then concat({m['schema_check']}, '\\n', if({view}, {m['view_backup']}, {m['backup_full']})) when {backed_up} then {m['backup_where']} end")
    inverse = _alter_inverse(o)
    rollback = F.expr(
        f"case when {replaces} then {m['reinsert']} when s.kind = 'CREATE_TABLE' then {m['drop_table']} when s.kind = 'CREATE_INDEX' then {m['drop_index']} when s.kind = 'CREATE_VIEW' then {m['drop_view']} "
        f"when {_METADATA} then nullif(array_join({inverse}, '\\n'), '') "
        f"when {full} then concat({m['schema_check']}, '\\n', {m['partition_check']}, '\\n', if({view}, {m['view_rollback']}, {structural})) "
        f"when s.kind = 'INSERT' then ins.rollback when s.kind = 'UPDATE' then if(size(s.update.set_columns) = 0, null, {update}) when s.kind in ('DELETE', 'TRUNCATE') then {m['reinsert']} end"
    )
    no_where = "coalesce(w, '') = ''"
    reliable = F.expr(f"case when {replaces} then true when {_METADATA} then forall({inverse}, x -> x is not null) when s.kind = 'INSERT' then ins.reliable when s.kind = 'UPDATE' then not {no_where} and coalesce(size(pk), 0) > 0 when s.kind = 'DELETE' then not {no_where} when s.kind = 'TRUNCATE' then true else false end")
    known = f"(s.kind in ('CREATE_TABLE', 'CREATE_INDEX', 'CREATE_VIEW', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE') or {_METADATA} or {full} or s.kind in {_SKIPPED})"
    lock = f"(s.kind in ('UPDATE', 'DELETE', 'TRUNCATE') or {replaces} or ({full} and not {view}))"
    incomplete = "'REPLACE rollback incomplete: cannot DELETE newly inserted rows statically, manual cleanup required'"
    of_replace = f"if({replaces}, rep.warning, null), if({replaces}, {incomplete}, null)" if o.replace_kind else "null"
    warnings = F.expr(
        "array_join(array_compact(array("
        f"if({full}, 'structure beyond LIKE (foreign keys, triggers, comments) is not kept', null), if({full}, 'partition check emitted', null), if({replaces}, null, ins.warning), {of_replace}, "
        f"if(s.kind = 'UPDATE' and coalesce(size(pk), 0) = 0, 'no primary key, fallback to all-column JOIN (less reliable)', null), if(s.kind in ('UPDATE', 'DELETE') and {no_where}, concat(s.kind, ' without WHERE, full table backup'), null), "
        f"case when s.kind = 'MERGE' then 'MERGE/UPSERT not supported, split into INSERT+UPDATE' when not {known} then concat('Unsupported statement kind: ', s.kind) end)), '; ')"
    )
    auto = "(s.kind = 'ALTER_TABLE' and exists(s.alter.ops, x -> contains(upper(x.detail), 'AUTO_INCREMENT') or contains(upper(x.detail), 'SERIAL')))"
    out = rows.select(
        "seq", "file_path", F.expr("s.line").alias("line"), F.expr(f"if({replaces}, 'REPLACE', s.kind)").alias("stmt_kind"), F.col("tbl").alias("target_table"), F.when(has_backup, F.col("bks")).alias("backup_table"), F.expr("s.stmt_text").alias("original_sql"),
        backup.alias("backup"), rollback.alias("rollback"), F.coalesce(reliable, F.lit(False)).alias("reliable"), F.expr(f"{full} or {replaces}").alias("partial"), F.expr(f"not {known}").alias("irreversible"),
        F.expr(f"s.kind = 'TRUNCATE' or ({full} and {auto})").alias("counter_unrestored"), F.expr(lock).alias("requires_lock"), F.lit(False).alias("partitioned"), F.expr(f"{full} and s.kind = 'DROP_TABLE'").alias("irreversible_if_backup_missing"),
        F.expr(f"case when {full} or s.kind = 'TRUNCATE' then 'full' when {backed_up} then 'incremental' end").alias("backup_mode"), warnings.alias("warnings"),
    )
    return finalize(out, o)


def finalize(out: DataFrame, o: Options = Options()) -> DataFrame:
    """Lock type by file (DDL or not) and review level."""
    has_ddl = F.max(F.expr(f"stmt_kind in {_DDL}")).over(Window.partitionBy("file_path"))
    kinds = {"global": "FTWRL", "snapshot": "SNAPSHOT", "table": "TABLE_UNSAFE", "none": "NONE"}
    lock = F.when(has_ddl, "FTWRL").otherwise("SNAPSHOT") if o.lock_scope == "auto" else F.lit(kinds.get(o.lock_scope, "FTWRL"))
    out = out.withColumn("lock_type", F.when(F.col("requires_lock"), lock))
    out = out.withColumn("lock_timeout_best_effort", F.coalesce(F.col("lock_type") == "FTWRL", F.lit(False))).withColumn("snapshot_window_unprotected", F.coalesce(F.col("lock_type") == "SNAPSHOT", F.lit(False)))
    required = F.col("irreversible") | F.col("irreversible_if_backup_missing") | ~F.col("reliable") | F.col("partial")
    return out.withColumn("review_level", F.when(required, "required").when(F.col("requires_lock") | F.col("counter_unrestored"), "optional").otherwise("none"))


def manifest(found: DataFrame, o: Options = Options()) -> DataFrame:
    """Counters and the exit code, one row."""
    n = lambda c: F.count_if(F.col(c) if isinstance(c, str) else c)
    row = found.agg(
        F.count(F.lit(1)).alias("statement_count"), n(F.col("backup").isNotNull()).alias("backup_count"), n(F.col("rollback").isNotNull()).alias("rollback_count"), n(~F.col("reliable")).alias("unreliable_count"),
        n("irreversible").alias("irreversible_count"), n("partial").alias("partial_count"), n("counter_unrestored").alias("counter_unrestored_count"), n("requires_lock").alias("requires_lock_count"), n("partitioned").alias("partitioned_count"),
        n("irreversible_if_backup_missing").alias("irreversible_if_backup_missing_count"), n(F.col("review_level") == "required").alias("required_review_count"), n(F.col("review_level") == "optional").alias("optional_review_count"),
        n(F.col("review_level") == "none").alias("auto_approved_count"),
    )
    bad = (F.col("irreversible_count") > 0) | (F.col("unreliable_count") > 0) | (F.col("irreversible_if_backup_missing_count") > 0) | ((F.col("partial_count") > 0) & F.lit(not o.allow_partial))
    warn = (F.col("counter_unrestored_count") > 0) | (F.col("requires_lock_count") > 0)
    return row.withColumn("exit_code", F.when(bad, 2).when(warn & F.lit(o.fail_on_warning), 2).when(warn, 1).otherwise(0))


def coalesced(found: DataFrame, o: Options = Options()) -> DataFrame:
    """found with `lock_group`: neighbours in a file that may share one lock (gaps and islands over the statement order).

    A pair joins the group before it if it backs up the same table and, unless the mode is aggressive, is a full backup.
    """
    own = Window.partitionBy("file_path").orderBy("seq")
    joins = F.col("backup").isNotNull() & (F.lag("backup_table_target").over(own) == F.col("backup_table_target"))
    if o.coalesce_mode != "aggressive":
        joins = joins & (F.col("backup_mode") == "full")
    rows = found.withColumn("backup_table_target", F.when(F.col("backup").isNotNull(), F.col("target_table")))
    rows = rows.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    return rows.withColumn("lock_group", F.sum("_new").over(own)).drop("_new", "backup_table_target")


def scripts(found: DataFrame, o: Options = Options()) -> DataFrame:
    """One row a file: backup script (ascending), rollback script (last statement first) and cleanup script."""
    strip = lambda x: F.regexp_replace(x, r"(?m)^(FLUSH TABLES WITH READ LOCK;|UNLOCK TABLES;|LOCK TABLE .*;)\n?", "") if o.lock_scope == "none" else x
    head = F.concat(F.lit("-- seq="), F.col("seq").cast("string"), F.lit(" source="), F.col("file_path"), F.lit(":"), F.col("line").cast("string"), F.lit("\n"))
    rows = found.select("file_path", "seq", F.when(F.col("backup").isNotNull(), F.concat(head, strip(F.col("backup")))).alias("b"), F.when(F.col("rollback").isNotNull(), F.concat(head, F.col("rollback"))).alias("r"),
                        F.when(F.col("backup_table").isNotNull(), F.expr(fill("DROP TABLE IF EXISTS {b};", b=quoted("backup_table", o)))).alias("c"))
    listed = lambda c: F.filter(F.collect_list(F.struct("seq", F.col(c).alias("sql"))), lambda x: x["sql"].isNotNull())
    text = lambda c, asc: F.array_join(F.transform(F.sort_array(F.col(c), asc=asc), lambda x: x["sql"]), "\n")
    grouped = rows.groupBy("file_path").agg(listed("b").alias("b"), listed("r").alias("r"), listed("c").alias("c"))
    wrap = (lambda x: F.concat(F.lit("BEGIN;\n"), x, F.lit("\nCOMMIT;\n"))) if not o.mysql and o.wrap_transaction else (lambda x: x)
    return grouped.select("file_path", wrap(text("b", True)).alias("backup_sql"), wrap(text("r", False)).alias("rollback_sql"), text("c", True).alias("cleanup_sql"))


def prerequisites(found: DataFrame, o: Options = Options(), accept_table_lock: bool = False, binlog: str = "off") -> DataFrame:
    """(file_path, problem): what must be settled before the scripts may run."""
    per_file = found.groupBy("file_path").agg(F.bool_or(F.expr(f"stmt_kind in {_DDL}")).alias("has_ddl"), F.bool_or("requires_lock").alias("locks"))
    problems = F.array_compact(F.array(
        F.when(F.col("locks") & F.lit(o.lock_scope == "table" and not accept_table_lock), "lock_scope=table is unsafe and was not accepted"),
        F.when(F.col("has_ddl") & F.lit(o.mysql and binlog == "auto"), "binlog control cannot be automatic with DDL"),
    ))
    return per_file.select("file_path", F.explode(problems).alias("problem"))


def review(found: DataFrame) -> DataFrame:
    """Statements to review, by level."""
    return found.where("review_level <> 'none'").select("review_level", "seq", "file_path", "line", "stmt_kind", "target_table", "warnings")


def long_transaction_check(dialect: str) -> str:
    """A statement that lists transactions that have run for a minute or more."""
    if dialect == "mysql":
        return "-- check: long transactions\nSELECT trx_id, trx_started FROM information_schema.innodb_trx WHERE trx_started < NOW() - INTERVAL 60 SECOND;\n"
    return "-- check: long transactions\nSELECT pid, xact_start FROM pg_stat_activity WHERE xact_start < now() - interval '60 seconds';\n"


def binlog_control(mode: str) -> str:
    """`off`: the session writes no binary log; otherwise nothing."""
    return "SET SESSION sql_log_bin = 0;\n" if mode == "off" else ""


def review_html(found: DataFrame, title: str = "Rollback review") -> str:
    """An HTML page of the statements to review, those that must be first."""
    import html

    parts = []
    rows = [r for level in ("required", "optional") for r in review(found).where(F.col("review_level") == level).orderBy("seq").toLocalIterator()]
    for level in ("required", "optional"):
        own = [r for r in rows if r.review_level == level]
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x if x is not None else ''))}</td>" for x in (r.seq, r.file_path, r.line, r.stmt_kind, r.target_table, r.warnings)) + "</tr>" for r in own)
        parts.append(f"<h2>{level} ({len(own)})</h2><table><tr><th>seq</th><th>file</th><th>line</th><th>kind</th><th>table</th><th>warnings</th></tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"
