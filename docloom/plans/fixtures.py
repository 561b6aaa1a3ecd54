"""Small in-line relations for domain rules, the same rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    ("d01", "Siemens order number 6ES72141AG400XB0. Programmable logic controller."),
    ("d02", "KROHNE OPTIFLUX 2000 flow meter. Electromagnetic flow measurement, IP67 and IP66, ATEX."),
    ("d03", "Output 4-20 mA, HART. Supply 24 V DC. 2-wire. Tag PT-102A."),
    ("d04", "Protocol: Modbus RTU. HART: non. Measuring range 0 to 100 bar."),
    ("d05", "Radar level transmitter. Continuous level measurement. Process temperature: -40...+200°C"),
    ("d06", "VEGA level sensor. NEMA 4X. Loop-powered. SIL 2, IECEx, FM."),
    ("d07", "signal at 4 mA without HART"),
    ("d08", "PCV-12 valve with positioner and actuator"),
    ("d09", "SOV-3 on the instrument air line"),
    ("d10", "HMI touchscreen, tft lcd, resolution 800x480, backlight, usb host"),
    ("d11", "Category: Pressure transmitter\nProduct Name: Cerabar\npressure pressure pressure"),
    ("d12", "Measuring range 10 to 5 bar, span 1,5 ... 20 mbar"),
    ("d13", "Range ratio. Measuring range 10:1 of 0 to 100 bar"),
    ("d14", ""),
    ("d15", "Rosemount 3051CD beside a KROHNE H250 and the Endress+Hauser Promag 53; made by Emerson"),
    ("d16", "Order No.: 7MF4033-1DA10-1AC6 page 12, panel KTP700 BASIC. Type: AB-12 x"),
    ("d17", "Vegapuls 64 by VEGA. Ref. No. 6AV2123-2GB03-0AX0, SIMATIC HMI panel KTP700 Comfort, range 4 to 20 mm"),
    ("d18", "Yokogawa EJA110E with 644H from Samson 3730-3; plage de mesure 0,5 à 1,5 bar"),
    ("d19", "SIMATIC S7-1200 CPU 1214C DC/DC/DC. Product: controller. Category: PLC. Measuring range 0 to 10 bar"),
]
VALUES = [
    ("plageMesureMin", "1,5 bar", "string"), ("plageMesureMax", "true", "boolean"), ("seuil", "none", "string"), ("hart", "Oui", "string"), ("sortieTOR", "0", "number"), ("hart", "maybe", "string"),
    ("nombreFils", "4-wire", "string"), ("nombreFils", "many", "string"), ("plageMesureUnite", "300.0", "string"), ("plageMesureUnite", " bar ", "string"), ("températureProcess", "-40...85 °C", "string"), ("températureProcess", "Autre: 3,23", "string"),
    ("category", "un actionneur", "string"), ("category", "pump", "string"), ("typeMesure", "Flow meter", "string"), ("typeMesure", "FÜLLSTAND", "string"), ("code", "pt-101", "string"), ("code", "xPDTx", "string"), ("code", "pHT", "string"),
    ("technologie", "radar fmcw", "string"), ("technologie", "Autre: laser", "string"), ("signalSortie", "4 ... 20 mA", "string"), ("signalSortie", "pulse", "string"), ("alimentation", "2-wire loop", "string"), ("alimentation", "24 V DC", "string"),
    ("alimentation", "85-264 VAC", "string"), ("communication", "aucune", "string"), ("communication", "hart 7", "string"), ("marque", "Rosemount 3051", "string"), ("marque", "Acme", "string"), ("matériauMembrane", "ptfe coated", "string"),
    ("indiceIP", "ip 68", "string"), ("indiceIP", "nema 4x", "string"), ("typeActionneur", "vanne on/off", "string"), ("precision", "  0.1 %  ", "string"), ("precision", "Autre: x", "string"), ("precision", "   ", "string"), ("marque", None, "string"),
]
CANDIDATES = [
    ("d1", "category", "Transmetteur/Capteur", 0.8, "model"), ("d1", "category", "Actionneur", 1.0, "isa_tag"), ("d1", "typeMesure", "Niveau", 0.9, "classifier"), ("d1", "typeMesure", None, 1.0, "isa_tag"), ("d1", "marque", None, 0.0, "model"),
    ("d2", "marque", "VEGA", 0.9, "classifier"), ("d2", "marque", "Acme", 0.99, "model"), ("d2", "precision", "0.1 %", 0.7, "model"), ("d2", "technologie", "Radar", 0.9, "classifier"), ("d2", "typeMesure", "Pression", 0.8, "classifier"), ("d2", "signalSortie", "4-20mA HART", 0.8, "model"),
]
EVIDENCE = [
    ("4-20mA", "string", True, 0.9, 0.28, None, 1.0), ("4-20mA", "string", True, 0.9, 0.28, 3.0, 1.0), ("Autre", "string", False, 0.9, 0.28, None, 1.0), (None, "string", False, 0.9, 0.28, None, 1.0), ("x", "string", False, 0.0, 0.9, None, 0.0),
    ("12.5", "number", False, None, None, None, 0.5), ("true", "boolean", False, 0.7, 0.1, -2.0, 0.75), ("Autre: laser", "string", False, 0.6, 0.4, 1.5, 0.3),
]
CONTEXTS = [("c1", "Actionneur", None, None, None), ("c2", "Transmetteur/Capteur", "Débit", True, "boucle"), ("c3", None, None, None, None), ("c4", "Transmetteur/Capteur", "Niveau", False, "24VDC")]
READINGS = [("o1", 0, "SIEMENS TYPE 7MF"), ("o1", 1, "siemens type 7mf4033 output 4-20 ma supply 24 v"), ("o1", 2, "noise"), ("o2", 0, "abb"), ("o2", 1, "ABB")]
FIELDS = [("o1", "model", 0, "7MF"), ("o1", "model", 1, "7MF4033"), ("o1", "serial", 2, None), ("o2", "model", 0, "AB1"), ("o2", "model", 1, "XY2")]
OCR = [("s1", "RosenOunt  OUNPUT 4-20mA\r\n\r\n\r\n\r\nTemperaiure Transmiter MODEL DIALK6 24 VDG psa"), ("s2", "clean text"), ("s3", None)]
LABELS = [
    ("m1", 0, "ROSEMOUNT TEMPERATURE TRANSMITER\nMODEL 3144P DIALK6 SERIAL NO. 0042908\nFACTORY CAL Pt100_385_ 4-WIRE/0 TO 100 C\nSUPPLY 12-42.4 VDG OUNPUT 4-20 mA HART 07/15"), ("m1", 1, "RCSEMOUNT MODEL 3144P\nNEMA TYPE 4X CSA ENCLOSURE TYPE 4X IP66 IP68 HW 1 SW 5.3.4 00421-0001"), ("m1", 2, "noise"), ("m1", 3, "1234-5678-9012 / AB psa SUPPLY"), ("m2", 0, "no label"),
]
GRIDS = [("t1", [["Name", "Value"], ["Range", "0|10"], ["", None], ["Extra", "x", "cut"], ["Short"]]), ("t2", [["", ""]])]
BLOCKS = [("b", 1, float(x), float(y), float(x + 10), float(y + 4), t, 0) for x, y, t in [(0, 10, "a"), (20, 14, "b"), (40, 18, "c"), (0, 30, "d"), (20, 31, "e"), (0, 50, "alone")]] + [("b", 1, 0.0, 60.0, 50.0, 80.0, "", 1)]

SCHEMAS = {
    "texts": "doc_id string, text string", "values": "field string, value string, value_type string", "candidates": "doc_id string, field string, value string, confidence double, source string",
    "evidence": "value string, value_type string, listed boolean, model double, distance double, rerank double, quote double", "contexts": "doc_id string, category string, typeMesure string, sortieTOR boolean, alimentation string",
    "readings": "doc_id string, ord int, text string", "fields": "doc_id string, field string, ord int, value string", "ocr": "doc_id string, text string", "labels": "doc_id string, ord int, text string", "grids": "table_id string, cells array<array<string>>",
    "blocks": "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, text string, block_type int",
}
ROWS = {"texts": TEXTS, "values": VALUES, "candidates": CANDIDATES, "evidence": EVIDENCE, "contexts": CONTEXTS, "readings": READINGS, "fields": FIELDS, "ocr": OCR, "labels": LABELS, "grids": GRIDS, "blocks": BLOCKS}


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(ROWS[name], SCHEMAS[name])


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return repr(v)


_SQL = {"string": "varchar", "int": "integer", "double": "double", "boolean": "boolean", "array<array<string>>": "varchar[][]"}


def values_sql(name: str) -> str:
    """The relation as a typed SELECT over VALUES."""
    columns = [c.split(" ", 1) for c in SCHEMAS[name].split(", ")]
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in ROWS[name])
    casts = ", ".join(f"{n}::{_SQL[t]} AS {n}" for n, t in columns)
    return f"(SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(n for n, _ in columns)}))"
