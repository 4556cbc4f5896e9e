"""Row types of the engine's tables, as DDL."""

BLOCKS = "block_idx int, text string, heading_level int, page int, is_table_row boolean, is_list_item boolean"
FINGERPRINT = "author string, last_modified_by string, created string, modified string, app string, revision string, total_edit_minutes long"
RAW_CHUNK = "chunk_type string, chunk_level string, section_path array<string>, text string, page int, order_index int"
ENTITIES = "array<struct<kind:string,value:string>>"
CLUSTERS = "job_id long, cluster_no int, members array<long>, primaries array<long>, avg double, peak double, min_pair double, lex_avg double, sem_avg double, member_scores array<double>"
