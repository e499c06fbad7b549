"""A small catalog of ships and berths for the tests of planning, and short forms of its records."""

from concordia.plans.model import TEXT, Catalog, Column, ForeignKey, Index, Sequence, Table

COLLATION = "Latin1_General_CI_AS"


def col(ordinal, name, kind, length=0, precision=0, scale=0, null=True, **more):
    collation = COLLATION if kind in TEXT else None
    return Column(ordinal, name, kind, length, precision, scale, null, collation, 1252 if collation else None, **more)


def pk(name, *keys):
    return Index(name, "PRIMARY_KEY", tuple((k, False) for k in keys))


def index(name, *keys, kind="INDEX", **more):
    return Index(name, kind, tuple((k, False) for k in keys), **more)


URGENCY = "(iif([state]='EMERGENCY',(0),(5)))"
SUFFIX = "(reverse(left(reverse([path]),(3))))"
SEQUENCE = Sequence("port", "permit_no", "bigint", 500, 5, -(1 << 63), (1 << 63) - 1, True, 615)


def given(definition):
    return ("df", definition)


VESSEL = Table("port", "Vessel", (
    col(1, "vessel_id", "int", 4, 10, 0, False, identity=(10, 2, 88)), col(2, "imo", "char", 7, null=False), col(3, "title", "nvarchar", 120, null=False), col(4, "call_sign", "varchar", 12),
    col(5, "tonnage", "decimal", 9, 12, 3), col(6, "tag", "uniqueidentifier", 16, null=False, default=given("(newid())")), col(7, "stamp", "rowversion", 8, null=False),
    col(8, "active", "bit", 1, 1, 0, False, default=given("((1))")), col(9, "built", "date", 3),
), (pk("pk_vessel", "vessel_id"), index("uq_vessel_imo", "imo", kind="UNIQUE_CONSTRAINT"), index("ix_vessel_title", "title")))

BERTH = Table("port", "Berth", (
    col(1, "quay", "nvarchar", 16, null=False), col(2, "berth_no", "smallint", 2, 5, 0, False), col(3, "depth", "real", 4, 24), col(4, "remarks", "nvarchar", -1), col(5, "keeper", "sysname", 256, default=given("(suser_sname())")),
), (pk("pk_berth", "quay", "berth_no"),))

VISIT = Table("port", "Visit", (
    col(1, "visit_id", "bigint", 8, 19, 0, False, identity=(1, 1, None)), col(2, "vessel_id", "int", 4, 10, 0, False), col(3, "quay", "nvarchar", 16), col(4, "berth_no", "smallint", 2, 5, 0),
    col(5, "arrived", "datetime", 8, 23, 3, False, default=given("(getdate())")), col(6, "left_at", "datetime2", 8, 27, 7), col(7, "fee", "money", 8, 19, 4), col(8, "pilots", "tinyint", 1, 3, 0, False, default=given("((2))")),
    col(9, "state", "varchar", 12, null=False, default=given("('PLANNED')")), col(10, "urgency", "int", 4, 10, 0, False, computed=URGENCY), col(11, "permit", "bigint", 8, 19, 0, False, default=given("(NEXT VALUE FOR [port].[permit_no])")),
), (pk("pk_visit", "visit_id"), index("ix_visit_when", "vessel_id", "arrived")), (
    ForeignKey("fk_visit_vessel", ("vessel_id",), "port.Vessel", ("vessel_id",)), ForeignKey("fk_visit_berth", ("quay", "berth_no"), "port.Berth", ("quay", "berth_no"), on_delete="CASCADE"),
), (), ("tr_visit_log",))

GAUGE = Table("port", "Gauge_Log", (col(1, "taken_on", "date", 3, null=False), col(2, "gauge", "sysname", 256, null=False), col(3, "level", "float", 8, 53), col(4, "raw", "varbinary", 64)), (pk("pk_gauge_log", "taken_on", "gauge"),))

SCAN = Table("port", "Scan", (
    col(1, "scan_id", "int", 4, 10, 0, False, identity=(1, 1, 31)), col(2, "visit_id", "bigint", 8, 19, 0), col(3, "path", "varchar", 260), col(4, "suffix", "varchar", 40, computed=SUFFIX), col(5, "words", "ntext", 16), col(6, "made", "datetimeoffset", 10, 34, 3),
), (pk("pk_scan", "scan_id"),), (ForeignKey("fk_scan_visit", ("visit_id",), "port.Visit", ("visit_id",)),))


def catalog() -> Catalog:
    return Catalog("harbor", (VISIT, VESSEL, SCAN, GAUGE, BERTH), (SEQUENCE,), (("VIEW", "due_today"), ("PROCEDURE", "assign_berth"), ("VIEW", "overdue")), COLLATION)


RULES = {
    "tables": {
        "port.Visit": {"columns": {"urgency": {"generated": "CASE WHEN state = 'EMERGENCY' THEN 0 ELSE 5 END"}, "state": {"nul_char": "replace"}}},
        "port.Scan": {"columns": {"suffix": {"generated": "right(path, 3)"}}},
    }
}
