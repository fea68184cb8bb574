import gzip

from conftest import rows

from geotrail import schemas
from geotrail.sources import dimensions, kafka
from geotrail.sources import locations as loc


def test_dump_rows(spark, tmp_path):
    path = tmp_path / "users.tsv"
    path.write_text("1\t0\n2\t\\N\n")
    assert rows(dimensions.read_dump(spark, str(path), schemas.USER_ROW), "id", "device") == [
        (1, 0), (2, None),
    ]
    path = tmp_path / "fences.tsv"
    path.write_text("7\t0103AB\t2024-03-09 14:42:50.493877+00\tt\t1\n8\t01\t\\N\tf\t2\n")
    got = dimensions.read_dump(spark, str(path), schemas.FENCE_ROW)
    assert rows(got, "id", "wkt", "valid", "category") == [(7, "0103AB", True, 1), (8, "01", False, 2)]


def test_gzip_message_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as out:
        out.write('{"id": 1, "point": {"x": 1.0, "y": 2.0}, "timestamp": 1000000}\nbroken\n')
    parsed = loc.parse_records(loc.read_message_files(spark, str(tmp_path)))
    assert loc.accepted(parsed).count() == 1 and loc.rejected(parsed).count() == 1


def test_location_records_are_keyed_by_device(spark):
    points = spark.sql("select 12L as device, 1.5D as x, 2.0D as y, timestamp_micros(1000001) as ts")
    record = loc.keyed_messages(points).first()
    assert record.key == "12"
    assert record.value == '{"id":12,"point":{"x":1.5,"y":2.0},"timestamp":1000001}'


def test_jdbc_options():
    query = dimensions.fence_query()
    options = dimensions.jdbc_options("jdbc:x", "me", "pw", "polygons", query, (3, 1002), 8)
    assert options["dbtable"].endswith("ST_AsText(fence) AS wkt FROM polygons) AS rows")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8"
    assert (options["lowerBound"], options["upperBound"]) == ("3", "1003")
    assert dimensions.jdbc_options("jdbc:x", "me", "pw", "users")["dbtable"] == "users"


def test_topic_options():
    login = kafka.secured(login="module required;")
    source = kafka.source_options("h:9092", kafka.COLLISIONS_TOPIC, committed_only=True, extra=login)
    assert source["startingOffsets"] == "earliest"
    assert source["kafka.isolation.level"] == "read_committed"
    assert source["kafka.sasl.jaas.config"] == "module required;"
    assert int(source["maxOffsetsPerTrigger"]) > 0
    sink = kafka.sink_options("h:9092", kafka.COLLISIONS_TOPIC)
    assert sink["topic"] == "collisions" and sink["kafka.acks"] == "all"


def test_topic_bytes_become_text(spark):
    raw = spark.sql("select binary('5') as key, binary('{}') as value, 3 as partition, 8L as offset")
    assert rows(kafka.text_columns(raw), "*") == [("5", "{}", 3, 8)]
