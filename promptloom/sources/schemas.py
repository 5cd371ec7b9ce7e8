"""Row types, written by hand; nothing is inferred."""

TABLE = "struct<name:string,synonym:string,use_synonym:boolean>"
FIELD = "struct<name:string,type:string,synonym:string,use_synonym:boolean>"
SELECT = "struct<name:string,aggregate:string,synonym:string,use_synonym:boolean>"
ORDER = "struct<name:string,asc:boolean>"
PAIR = f"struct<main:{FIELD},joined:{FIELD}>"

ITEM_COLUMNS = (
    "item_id", "source_csn", "command_set", "table_name", "table_fields", "create_statement",
    "select", "order_by", "order_by_phrase", "agg_phrases", "english_prompt", "sql_statement",
    "where_fields", "where_literals", "where", "join_table", "join_fields", "join_condition",
    "join_create_statement",
)
# The ten columns of a flat dataset row.
FLAT_COLUMNS = (
    "command_set", "table_name", "table_name_synonym", "table_name_use_synonym",
    "create_statement", "english_prompt", "sql_statement", "table_fields", "select", "order_by",
)
# Split names.
SPLITS = ("train", "validation", "test")
