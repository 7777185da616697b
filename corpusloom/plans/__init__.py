"""Whole question-to-answer plans and the registered queries."""
