"""Readers: column-oriented JSON tables, inventory text, result cells, corpora."""

from traitgrid.sources.columns_json import (  # noqa: F401
    read_columns_json, read_key, read_personas, read_responses, read_result_tree, read_score_cards,
)
from traitgrid.sources.inventory import read_inventory_text  # noqa: F401
from traitgrid.sources.results import read_cells, list_cells, list_files, list_models, read_run_files, read_split  # noqa: F401
