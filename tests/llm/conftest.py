import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Small tables from rows; columns beyond the schema's clash with names that operators use inside."""

    def build(rows, schema, extra="kept boolean, n long, label int, value long, _j long, snapshot int, weight double"):
        names = [c.split()[0] for c in schema.split(", ")]
        more = [c for c in extra.split(", ") if c.split()[0] not in names]
        return spark.createDataFrame([tuple(r) + (None,) * len(more) for r in rows], ", ".join([schema, *more]))

    return build
