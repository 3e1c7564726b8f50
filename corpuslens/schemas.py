"""Column layouts shared by operators and plans."""

CHUNK_FIELDS = [
    "chunk_id", "title", "cancer_type", "topic", "audience", "section", "section_path",
    "url", "source_file", "text",
]
