"""Registered queries of the training-data operators: importing this package fills the registry."""

from promptspread.llm.queries import op1, op10, op11, op12, op13, op2, op3, op4, op5, op6, op7, op8, op9  # noqa: F401
from promptspread.llm.registry import ORACLES, QUERIES  # noqa: F401
