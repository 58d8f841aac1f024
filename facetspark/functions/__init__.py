"""Column -> Column helpers."""
from facetspark.functions.text import (  # noqa: F401
    MISSING_LABEL, NULL_TEXT, classifier_text, cut_marker, extract_fields, extraction_pattern,
    last_word, num_text, render_fields, strip_line, strip_ws, to_json_text, value_text,
)
