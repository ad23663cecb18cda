"""Schemas shared by the operators, and the vocabulary of the graph formats."""

from __future__ import annotations

READING = "machine int, sensor int, ts long, lts long, value double"
SCORE = "machine int, sensor int, oldest_lts long, ordinal long, probability double"
METADATA = "machine int, type string, sensor int, k int, pt double"

# Names of the input and output formats.
RESOURCE = "http://project-hobbit.eu/resources/debs2017#"
I40 = "http://www.agtinternational.com/ontologies/I4.0#"
IOT = "http://www.agtinternational.com/ontologies/IoTCore#"
WMD = "http://www.agtinternational.com/ontologies/WeidmullerMetadata#"
RESULT = "http://www.agtinternational.com/ontologies/DEBSAnalyticResults#"
SSN = "http://purl.oclc.org/NET/ssnx/ssn#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
TERMINATION = "~~Termination Message~~"
