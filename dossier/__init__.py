"""Document intelligence over Spark tables: blocks, fields, reviews, exports."""
