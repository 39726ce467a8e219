"""Prompt construction. Literal concatenation only (no format strings, so a
``%`` or ``{`` inside an item stays as is)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitgrid.functions.text import _c

# The instrument's prompt wording, reproduced verbatim.
RATING_PREFIX = ' Evaluating the statement "'
RATING_SUFFIX = (
    '",  please rate how accurately this describes you on a scale from 1 to 5 '
    '(where 1 = "very inaccurate", 2 = "moderately inaccurate", 3 = "neither accurate nor inaccurate", '
    '4 = "moderately accurate", and 5 = "very accurate"). Always reply with a single digit from 1 to 5.'
    ' In your answer, do not mention digits other than the one you answer with. '
)
AGREEMENT_INTRO = (
    "\nYou will be given a statement. Respond with your agreement level from 1 to 5 using this scale:\n"
    "\n"
    "1 = Strongly disagree  \n"
    "2 = Disagree  \n"
    "3 = Neither agree nor disagree  \n"
    "4 = Agree  \n"
    "5 = Strongly agree\n"
    "\n"
    "Always reply with a single digit from 1 to 5. In your answer, do not mention digits other than the one you answer with.\n"
    "\n"
)
STATEMENT_OPEN = 'Statement: "'
STATEMENT_CLOSE = '"\nYour agreement level (1-5): '


def rating_prompt(persona, question) -> Column:
    """API form: persona + prefix + item + rating-scale suffix."""
    return F.concat(F.coalesce(_c(persona), F.lit("")), F.lit(RATING_PREFIX), _c(question), F.lit(RATING_SUFFIX))


def statement(question) -> Column:
    """The agreement template with the item filled in."""
    return F.concat(F.lit(STATEMENT_OPEN), _c(question), F.lit(STATEMENT_CLOSE))


def agreement_prompt(question, persona=None, intro: str = AGREEMENT_INTRO) -> Column:
    """Local-model form: ``persona + '\\n'`` (if any) + intro + filled template."""
    head = F.lit("") if persona is None else F.when(
        F.coalesce(_c(persona), F.lit("")) == "", F.lit("")).otherwise(F.concat(_c(persona), F.lit("\n")))
    return F.concat(head, F.lit(intro), statement(question))


def chat_prompt(user, system=None) -> Column:
    """Chat messages ``[{role: system, content}, {role: user, content}]``; the
    system turn is left out when ``system`` is None."""
    def msg(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    msgs = [] if system is None else [msg("system", system if isinstance(system, Column) else F.lit(system))]
    msgs.append(msg("user", _c(user)))
    return F.array(*msgs)
