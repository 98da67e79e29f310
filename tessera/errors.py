"""Errors a query can be refused with, each a class of its own."""


class QueryError(Exception):
    """Any refusal by the engine."""


class UnknownRelation(QueryError):
    pass


class ColumnOutOfBounds(QueryError):
    pass


class EquivalenceArityMismatch(QueryError):
    pass


class TypeMismatch(QueryError):
    pass


class EquivalenceNotCongruent(QueryError):
    """The asked equality is finer than the column's own, or unrelated to it."""


class OrderingNotCongruent(QueryError):
    """The ordering tells apart rows that the column's equality takes for one."""


class NonFiniteValue(QueryError):
    pass


class NonFiniteMultiplicity(QueryError):
    pass


class AtomOutsideCarrier(QueryError):
    pass


class Cardinality(QueryError):
    pass


class InvalidCursor(QueryError):
    pass


class AccessDenied(QueryError):
    pass


class LimitExceeded(QueryError):
    pass


class UnsupportedType(QueryError):
    pass


class Conflict(QueryError):
    """A change that may not be committed as it stands."""


class RuleBroken(Conflict):
    """A change after which a required rule would not hold."""


class NonReversible(QueryError):
    pass


class ReadOnlyView(QueryError):
    pass
