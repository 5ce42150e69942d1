"""termloom: boolean full-text queries and term statistics on Spark DataFrames."""

from termloom.context import BooleanContext
from termloom.plans.ast import And, Not, Or, Term
from termloom.plans.builder import BooleanPredicateBuilder
from termloom.plans.parser import parse_query

__all__ = ["And", "BooleanContext", "BooleanPredicateBuilder", "Not", "Or", "Term", "parse_query"]
