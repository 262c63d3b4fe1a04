"""Standard terms and their ids, namespaces, and functions on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

#: The standard terms by id.
STANDARD_TERMS = {
    0: f"<{RDF}type>",
    1: f"<{RDF}Property>",
    2: f"<{RDFS}range>",
    3: f"<{RDFS}domain>",
    4: f"<{RDFS}subPropertyOf>",
    5: f"<{RDFS}subClassOf>",
    6: f"<{OWL}Class>",
    7: f"<{OWL}FunctionalProperty>",
    8: f"<{OWL}InverseFunctionalProperty>",
    9: f"<{OWL}SymmetricProperty>",
    10: f"<{OWL}TransitiveProperty>",
    11: f"<{OWL}sameAs>",
    12: f"<{OWL}inverseOf>",
    13: f"<{OWL}equivalentClass>",
    14: f"<{OWL}equivalentProperty>",
    15: f"<{OWL}hasValue>",
    16: f"<{OWL}onProperty>",
    17: f"<{OWL}someValuesFrom>",
    18: f"<{OWL}allValuesFrom>",
    19: f"<{RDFS}member>",
    20: f"<{RDFS}Literal>",
    21: f"<{RDFS}ContainerMembershipProperty>",
    22: f"<{RDFS}Datatype>",
    23: f"<{RDFS}Class>",
    24: f"<{RDFS}Resource>",
    25: f"<{RDF}rest>",
    26: f"<{RDF}first>",
    27: f"<{RDF}List>",
    28: f"<{RDF}nil>",
    29: f"<{OWL}propertyChainAxiom>",
    30: f"<{OWL}hasKey>",
    31: f"<{OWL}intersectionOf>",
    32: f"<{OWL}unionOf>",
    33: f"<{OWL}oneOf>",
    34: f"<{OWL}Thing>",
    35: '"1"^^http://www.w3.org/2001/XMLSchema#nonNegativeInteger',
    36: f"<{OWL}maxCardinality>",
    37: f"<{OWL}maxQualifiedCardinality>",
    38: f"<{OWL}onClass>",
    39: f"<{OWL}Nothing>",
    40: f"<{OWL}DatatypeProperty>",
    41: f"<{OWL}ObjectProperty>",
}
#: The first id of popular terms, how many there may be, and the first id of all others.
FIRST_POPULAR, MOST_POPULAR, FIRST_OTHER = 100, 100, 200

TYPE, RANGE, DOMAIN, SUBPROPERTY, SUBCLASS = (STANDARD_TERMS[k] for k in (0, 2, 3, 4, 5))
#: Predicates of schema triples.
SCHEMA_PREDICATES = [RANGE, DOMAIN, SUBPROPERTY, SUBCLASS]

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL}


def standard_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STANDARD_TERMS.items()), "id bigint, term string")


def kind(term: Column) -> Column:
    """iri, bnode or literal."""
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")


def lexical(term: Column) -> Column:
    """The text between a literal's quotes, still escaped; null for other terms."""
    return F.when(term.startswith('"'), F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1))


def language(term: Column) -> Column:
    """A literal's language tag; null if it has none."""
    found = F.regexp_extract(term, r'^"(?:[^"\\]|\\.)*+"@(\S+)$', 1)
    return F.when(found != "", found)


def datatype(term: Column) -> Column:
    """A literal's datatype as written; null if it has none."""
    found = F.regexp_extract(term, r'^"(?:[^"\\]|\\.)*+"\^\^(\S+)$', 1)
    return F.when(found != "", found)


def escaped(text: Column) -> Column:
    """Text as it stands between the quotes of an N-Triples literal."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def iri(*parts: Column | str) -> Column:
    return F.concat(F.lit("<"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts], F.lit(">"))
