"""The query engine: a graph, sources of series, and queries over both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from tidegraph.functions.aggregates import in_order
from tidegraph.functions.expressions import FUNCTIONS, Typed, time_functions
from tidegraph.plans.compile import Compiler, Options
from tidegraph.sources.graph import TripleStore
from tidegraph.sources.series import SeriesSource
from tidegraph.sparql import algebra as A
from tidegraph.sparql.parser import parse

VOCABULARY = "urn:tidegraph:series#"


class Engine:
    """Answers SPARQL SELECT queries, and queries of the path language, over a graph and the series it refers to.

    vocabulary is the namespace of the predicates hasTimeseries, hasDataPoint, hasValue, hasTimestamp, hasDatatype and hasExternalId
    and of the functions DateTimeAsSeconds, DateTimeAsNanos, SecondsAsDateTime, NanosAsDateTime, like and the aggregate
    nestAggregation. Results are lazy DataFrames with a column for each variable, null where it is unbound. nulls_last:
    where ORDER BY puts unbound values.
    """

    def __init__(self, triples: DataFrame | TripleStore, vocabulary: str = VOCABULARY, prefixes: dict[str, str] | None = None, nulls_last: bool = True) -> None:
        self.store = triples if isinstance(triples, TripleStore) else TripleStore(triples, prefixes)
        self.vocabulary = vocabulary
        self.series: SeriesSource | None = None
        self.options = Options(vocabulary, FUNCTIONS | time_functions(vocabulary), {vocabulary + "nestAggregation": lambda v, by: in_order(v, by)}, nulls_last)
        self.predicate_of_names: str | None = None
        self.connectives: dict[str, str] = {}
        self.name_template: Sequence[tuple] | None = None
        self.type_template: Sequence[tuple] | None = None

    def set_time_series(self, source: SeriesSource) -> Engine:
        self.series = source
        return self

    def register_function(self, iri: str, f: Callable[..., Typed]) -> Engine:
        """A function under an IRI: of pairs (column, type) to such a pair; the type may be None."""
        self.options.functions[iri] = f
        return self

    def register_aggregate(self, iri: str, f: Callable[[Column, Sequence[str]], Column]) -> Engine:
        """An aggregate under an IRI: of a column and the names of the group's columns of time to a column."""
        self.options.aggregates[iri] = f
        return self

    def name_predicate(self, iri: str) -> Engine:
        self.predicate_of_names = iri
        return self

    def templates(self, names: Sequence[tuple] | None = None, types: Sequence[tuple] | None = None) -> Engine:
        """Triple templates by which the path language finds an element by name and by type, in place of those with the predicate of names."""
        self.name_template, self.type_template = names, types
        return self

    def connective_mapping(self, mapping: dict[str, str]) -> Engine:
        self.connectives = dict(mapping)
        return self

    def parse(self, query: str) -> A.Node:
        return parse(query, frozenset(self.options.aggregates))

    def execute(self, node: A.Node) -> DataFrame:
        return Compiler(self.store, self.series, self.options).run(node)

    def execute_hybrid_query(self, query: str) -> DataFrame:
        return self.execute(self.parse(query))

    def execute_dsl_query(self, text: str) -> DataFrame:
        from tidegraph.dsl.parser import parse_query
        from tidegraph.dsl.translate import Translator

        translator = Translator(self.vocabulary, self.predicate_of_names, self.connectives, self.name_template, self.type_template)
        return self.execute(translator.translate(parse_query(text)))
