"""Explicit schemas of all tables; nothing is inferred."""

from __future__ import annotations

ORDER_ITEM = "struct<text:string,asc:boolean,nulls_first:boolean>"
JOIN = "struct<table_name:string,join_type:string,has_condition:boolean,alias:string,condition_text:string,explicit_join_type:boolean>"
WINDOW = "struct<name:string,has_partition_by:boolean,has_order_by:boolean,has_frame:boolean>"
EDGE = "struct<left_table:string,left_column:string,right_table:string,right_column:string,join_type:string>"
SELECT = (
    "struct<select_id:int,parent_id:int,depth:int,multiplicity:bigint,role:string,text:string,projection:array<string>,projection_kinds:array<string>,has_star:boolean,has_wildcard:boolean,"
    "is_distinct:boolean,has_unqualified_column:boolean,table_count:int,from_tables:array<string>,from_aliases:array<string>,has_comma_join:boolean,has_from_subquery:boolean,"
    f"from_subquery_has_alias:boolean,joins:array<{JOIN}>,where_clause:string,where_kind:string,has_group_by:boolean,group_by:array<string>,having:string,qualify:string,"
    f"has_order_by:boolean,order_by:array<{ORDER_ITEM}>,order_by_text:string,has_limit:boolean,has_offset:boolean,has_fetch:boolean,is_union:boolean,is_union_all:boolean,is_intersect:boolean,"
    f"is_except:boolean,cte_names:array<string>,recursive:boolean,qualifiers:array<string>,window_functions:array<{WINDOW}>,edges:array<{EDGE}>>"
)
COLUMN = "struct<name:string,data_type:string,nullable:boolean,primary_key:boolean,is_unique:boolean,auto_increment:boolean,default_value:string,comment:string>"
NAMED_COLUMNS = "struct<name:string,columns:array<string>>"
CREATE_TABLE = (
    f"struct<table_name:string,columns:array<{COLUMN}>,primary_key_columns:array<string>,primary_key_name:string,has_primary_key:boolean,foreign_keys:array<struct<name:string,columns:array<string>,"
    f"ref_table:string,ref_columns:array<string>>>,checks:array<struct<name:string,expression:string>>,indexes:array<{NAMED_COLUMNS}>,uniques:array<{NAMED_COLUMNS}>,is_ctas:boolean,if_not_exists:boolean>"
)
ALTER = (
    "struct<table_name:string,adds_primary_key:boolean,drops_primary_key:boolean,added_primary_key_columns:array<string>,"
    "ops:array<struct<operation_type:string,column_name:string,table_name:string,constraint_name:string,detail:string,plain:boolean>>>"
)
STATEMENT = (
    "struct<kind:string,line:bigint,end_line:bigint,column:bigint,stmt_text:string,"
    f"create_table:{CREATE_TABLE},drop:struct<object_type:string,name:string,if_exists:boolean>,alter:{ALTER},"
    "insert:struct<table_name:string,columns:array<string>,source_kind:string,replace:boolean>,"
    "update:struct<table_name:string,set_columns:array<string>,where_clause:string,has_subquery:boolean,has_order_by:boolean,has_group_by:boolean>,"
    "delete:struct<table_name:string,where_clause:string,has_order_by:boolean,has_group_by:boolean>,truncate:struct<table_name:string>,"
    "view:struct<name:string,materialized:boolean,has_order_by:boolean,definition:string>,"
    f"create_index:struct<name:string,table_name:string,columns:array<string>,is_unique:boolean,concurrently:boolean>,selects:array<{SELECT}>>"
)
COMMENT = "struct<text:string,line:bigint,kind:string>"
AST = f"struct<parse_error:string,has_comma_join_anywhere:boolean,comments:array<{COMMENT}>,statements:array<{STATEMENT}>>"

SCRIPTS = "file_path string, script_type string, text string"
VIOLATIONS = "rule_id string, rule_name string, rule_group string, severity string, message string, file_path string, script_type string, line bigint, end_line bigint, `column` bigint"
HUNKS = "path string, side string, start_line bigint, end_line bigint, is_new boolean"
MAPPER_SQL = (
    "file_path string, statement_id string, statement_type string, raw_xml_line bigint, raw_sql string, sql_all string, sql_exclusive string, sql_first string, "
    "has_dynamic boolean, has_dollar boolean, n_ifs int, variants array<struct<sql:string,label:string>>"
)
PLAN_NODES = (
    "stmt_id string, node_id int, parent_id int, child_idx int, node_type string, relation string, index_name string, startup_cost double, total_cost double, "
    "plan_rows bigint, actual_rows bigint, actual_loops bigint, has_actual boolean, filter string, index_cond string, sort_key string"
)
