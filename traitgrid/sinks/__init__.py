"""Writers: cell-partitioned results, column-oriented JSON, cards, Markdown."""

from traitgrid.sinks.writers import (  # noqa: F401
    write_cells, write_column_files, write_columns_json, write_response_files, write_run_cards, write_score_card, write_markdown, write_table, training_dataset,
)
