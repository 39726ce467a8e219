"""traitgrid: questionnaire experiments as Spark DataFrame jobs.

Instruments and persona catalogues in, a prompt grid out; replies (collected
by a user-supplied responder) in, trait scores, reports, training sets and
reward scores out. Every public function takes and returns DataFrames or
Columns; all heavy lifting is Spark's own operators.
"""

from traitgrid.schemas import TRAITS, TRAIT_CODES, RatingScale, DEFAULT_SCALE  # noqa: F401

__version__ = "0.1.0"
