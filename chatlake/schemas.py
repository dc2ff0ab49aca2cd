"""Explicit schemas of the source and lake tables."""

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "double": T.DoubleType(),
}


def _schema(spec: str) -> T.StructType:
    pairs = (field.split() for field in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Source side.
MESSAGE = _schema(
    "rowid bigint, guid string, text string, attributed_body binary, handle_id bigint, date bigint, "
    "date_read bigint, date_delivered bigint, is_from_me int, is_read int, is_delivered int, is_sent int, "
    "service string, account string, error int"
)
HANDLE = _schema("handle_id bigint, id string, country string, service string")
CHAT = _schema("chat_id bigint, display_name string")
CHAT_MESSAGE_JOIN = _schema("chat_id bigint, message_id bigint, message_date bigint")
CHAT_HANDLE_JOIN = _schema("chat_id bigint, handle_id bigint")
CONTACT_RECORD = _schema("source string, z_pk bigint, first_name string, last_name string")
CONTACT_PHONE = _schema("source string, owner bigint, point_id bigint, full_number string")
CONTACT_EMAIL = _schema("source string, owner bigint, point_id bigint, address string")
ACCOUNT = _schema("account_type string, display_name string, external_identifier string")

# Lake side. '' marks an absent name, phone or e-mail.
USERS = _schema(
    "user_id string, first_name string, last_name string, phone_number string, email string, handle_id bigint"
)
CHATS = CHAT
CHAT_USERS = _schema("chat_id bigint, user_id string")
MESSAGES = _schema(
    "message_id bigint, user_id string, contents string, is_from_me boolean, created_at timestamp"
)
CHAT_MESSAGES = _schema("chat_id bigint, message_id bigint, message_date timestamp")
# Messages of a sync whose handle is not known yet, their text already read.
PENDING = _schema(
    "rowid bigint, handle_id bigint, text string, contents string, date bigint, is_from_me int"
)
SYNC_PROGRESS = _schema(
    "batch_id bigint, rows_read bigint, rows_synced bigint, last_rowid bigint, sync_status string, "
    "synced_at timestamp"
)

# Records exchanged with a text model.
REQUEST = _schema("chat_id bigint, user_id string, contents string")
RESPONSE = _schema("response_1 string, response_2 string, response_3 string")
HISTORY_LINE = _schema("contents string, is_from_me boolean, created_at string")
NEW_MESSAGE = _schema("contents string, created_at string")
PROMPT = T.StructType([
    T.StructField("system_prompt", T.StringType()),
    T.StructField("user_prompt", T.StringType()),
    T.StructField("chat_history", T.ArrayType(HISTORY_LINE)),
    T.StructField("new_message", NEW_MESSAGE),
])
BOUNDARIES = T.ArrayType(
    _schema("after_message_index bigint, reason string, confidence double")
)
