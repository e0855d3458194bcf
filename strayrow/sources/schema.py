"""Declared schemas in the text form ``name: kind.``, and the connection-record preset."""

from __future__ import annotations

from pyspark.sql import types as T

# Kind names of the schema text and the types they stand for.
KINDS = {
    "continuous.": T.DoubleType(),
    "symbolic.": T.IntegerType(),
    "string.": T.StringType(),
}

# The public KDD Cup 1999 connection record, in file order.
CONNECTION_FIELDS = """duration: continuous.
protocol_type: string.
service: string.
flag: string.
src_bytes: continuous.
dst_bytes: continuous.
land: symbolic.
wrong_fragment: continuous.
urgent: continuous.
hot: continuous.
num_failed_logins: continuous.
logged_in: symbolic.
num_compromised: continuous.
root_shell: continuous.
su_attempted: continuous.
num_root: continuous.
num_file_creations: continuous.
num_shells: continuous.
num_access_files: continuous.
num_outbound_cmds: continuous.
is_host_login: symbolic.
is_guest_login: symbolic.
count: continuous.
srv_count: continuous.
serror_rate: continuous.
srv_serror_rate: continuous.
rerror_rate: continuous.
srv_rerror_rate: continuous.
same_srv_rate: continuous.
diff_srv_rate: continuous.
srv_diff_host_rate: continuous.
dst_host_count: continuous.
dst_host_srv_count: continuous.
dst_host_same_srv_rate: continuous.
dst_host_diff_srv_rate: continuous.
dst_host_same_src_port_rate: continuous.
dst_host_srv_diff_host_rate: continuous.
dst_host_serror_rate: continuous.
dst_host_srv_serror_rate: continuous.
dst_host_rerror_rate: continuous.
dst_host_srv_rerror_rate: continuous.
label: string."""

STAMP_FIELDS = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("utc", T.StringType()),
        T.StructField("index", T.LongType()),
    ]
)


def schema_from_text(text: str) -> T.StructType:
    """``name: kind.`` lines as a schema; every column nullable, an unknown kind is a string."""
    schema = T.StructType()
    for line in text.strip().splitlines():
        name, _, kind = line.strip().partition(": ")
        schema.add(name, KINDS.get(kind, T.StringType()), True)
    return schema


def numeric_columns(schema: T.StructType) -> list[str]:
    """The feature columns of a declared schema: all that are not text, in order."""
    return [f.name for f in schema.fields if not isinstance(f.dataType, T.StringType)]


def connection_schema() -> T.StructType:
    return schema_from_text(CONNECTION_FIELDS)


def connection_features() -> list[str]:
    return numeric_columns(connection_schema())


def message_schema(record: T.StructType) -> T.StructType:
    """A record plus its four stamp fields, as carried in a message."""
    return T.StructType(record.fields + STAMP_FIELDS.fields)
