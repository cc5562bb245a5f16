"""Errors with the numeric codes that the SQL dialect documents."""

from __future__ import annotations


class EngineError(Exception):
    code = 9999

    def __init__(self, message: str):
        super().__init__(f"{message} (error {self.code})")


class InvalidSyntax(EngineError):
    code = 2000


class InvalidConfig(EngineError):
    code = 1000


class SchemaError(EngineError):
    code = 2003


class UnknownField(EngineError):
    code = 2004


class UnknownType(EngineError):
    code = 2023


class TypeMismatch(EngineError):
    code = 2006


class StampError(EngineError):
    code = 2007


class JoinError(EngineError):
    code = 2008


class UnknownSource(EngineError):
    code = 2030


class SourceExists(EngineError):
    code = 2031


class UnknownSink(EngineError):
    code = 2033


class SinkExists(EngineError):
    code = 2034


class QueryExists(EngineError):
    code = 2035


class UnknownSourceKind(EngineError):
    code = 2017


class UnknownSinkKind(EngineError):
    code = 2016


class UnsupportedStatement(EngineError):
    code = 2029


class UnknownModel(EngineError):
    code = 2040


class LateRow(EngineError):
    code = 3014


#: Codes of errors that rows raise while a query runs.
ARITHMETIC, FORMAT = 3013, 4003
