"""Table and landing-file schemas. Times are exact microseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()
NAMES = T.ArrayType(S)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MESSAGES = _schema(
    id=S, conversation_name=S, conversation_type=S, ts_us=L, datetime=S,
    user_name=S, author_name=S, text=S, clean_text=S, message_type=S, subtype=S,
    thread_ts_us=L, is_thread_parent=B, reply_count=L, has_attachments=B,
    has_reactions=B, is_edited=B, edited_ts_us=L, mentions_users=NAMES,
    contains_links=B, word_count=L, search_text=S,
)

CONVERSATIONS = _schema(
    id=S, name=S, type=S, participants=NAMES, created_at=TS, updated_at=TS,
    message_count=L, latest_message_ts_us=L,
)

USERS = _schema(
    slack_id=S, name=S, display_name=S, real_name=S, email=S, is_bot=B,
    created_at=TS, updated_at=TS,
)

CHANNELS = _schema(
    slack_id=S, name=S, display_name=S, purpose=S, topic=S, is_private=B,
    member_count=L, created_at=TS, updated_at=TS,
)

ATTACHMENTS = _schema(
    id=S, message_id=S, file_name=S, file_type=S, file_size=L, url_private=S,
    title=S, is_image=B, is_video=B, is_document=B,
)

REACTIONS = _schema(message_id=S, emoji=S, emoji_name=S, user_name=S, ts_us=L)

SYNC_STATE = _schema(conversation_id=S, last_ts_us=L)

# Kept beside the messages by the load, per type and date (`operators.kept`).
DAILY = _schema(
    conversation_type=S, dt=S, conversation_name=S, user_name=S, messages=L, first_ts_us=L, last_ts_us=L,
)
GRAMS = _schema(conversation_type=S, dt=S, gram=S, conversation_name=S)
REPLIES = T.StructType([*MESSAGES.fields, T.StructField("root_dt", S)])

# Landing files: one JSON object per line, read field by field as variants, so that a
# field of an odd type costs that field and not the message. Array items stay text, so
# that one odd item does not null the whole array; `edited` stays text because an
# empty object means "not edited" while an object without ts means "edited".
RAW_MESSAGE = _schema(
    conversation_id=S, conversation_type=S, ts=S, user=S, text=S, thread_ts=S,
    reply_count=L, subtype=S, bot_id=S, app_id=S, edited=S,
    files=NAMES, attachments=NAMES, reactions=NAMES, blocks=NAMES,
)
CORRUPT = "_corrupt"

RAW_USER = _schema(
    id=S, name=S, real_name=S, is_bot=B,
    profile=_schema(display_name=S, email=S),
)
RAW_CHANNEL = _schema(
    id=S, name=S, purpose=_schema(value=S), topic=_schema(value=S),
    is_private=B, num_members=L,
)
RAW_DM = _schema(id=S, is_im=B, is_mpim=B, user=S, members=NAMES)

FILE_ITEM = _schema(name=S, filetype=S, size=L, url_private=S, title=S, mimetype=S)
LINK_ITEM = _schema(title=S, title_link=S)
REACTION_ITEM = _schema(name=S, users=NAMES)
BLOCK_ITEM = _schema(type=S, elements=NAMES)
SECTION_ITEM = _schema(type=S, elements=NAMES)
ELEMENT_ITEM = _schema(type=S, text=S, name=S, user_id=S)

# Application records handed over by callers; the time may arrive as text.
USER_RECORD = _schema(id=S, name=S)
MESSAGE_RECORD = _schema(
    message_id=S, conversation_id=S, user_id=S, text=S, timestamp=S, thread_ts=S, raw=S,
)
CONVERSATION_RECORD = _schema(id=S, name=S, type=S, participants=NAMES)
