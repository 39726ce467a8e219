"""Column-level building blocks (built-in Spark expressions only, no UDFs)."""

from traitgrid.functions.text import py_strip, first_char, strip_echo, normalize_item, ascii_digits  # noqa: F401
from traitgrid.functions.ratings import (  # noqa: F401
    digit_strings, extract_number, rating_text, rating_value, reverse_key,
    round_half_even, format_score, parse_score, python_round_ratio,
)
from traitgrid.functions.prompts import rating_prompt, statement, agreement_prompt, chat_prompt  # noqa: F401
from traitgrid.functions.rewards import rating_reward, format_reward, xml_answer, hash_answer  # noqa: F401
from traitgrid.functions.models import provider, api_model_name  # noqa: F401
from traitgrid.functions.files import run_file_name, parse_run_file, contains_ci, cohort_of, cohorts_of  # noqa: F401
