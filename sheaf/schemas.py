"""Table schemas, as DDL strings."""

FILES = "bundle_id string, source_ord int, direct boolean, path string, length bigint, content binary"
RULES = (
    "ruleset_id string, rule_ord int, pattern string, negated boolean, "
    "directory_only boolean, anchored boolean"
)
RULE_LINES = "ruleset_id string, line_no int, line string"
PARAGRAPHS = "bundle_id string, source_ord int, path string, line_no int, style string, text string"
STREAM = "bundle_id string, seq bigint, style string, text string"
UNPACKED = (
    "bundle_id string, seg_no bigint, part_no bigint, heading string, path string, "
    "content string, error string"
)
BUNDLES = (
    "bundle_id string, header string, file_count bigint, binary_skipped bigint, "
    "output_name string, error string"
)
