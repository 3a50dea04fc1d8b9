"""Declared schemas of the tables at the edges of the flow."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PORTAL_CATALOG = _struct(
    id=T.StringType(),
    name=T.StringType(),
    login_url=T.StringType(),
    target_url=T.StringType(),
    description=T.StringType(),
    created_at=T.TimestampType(),
)

LOGIN_FIELDS = _struct(url_id=T.StringType(), selector=T.StringType(), value=T.StringType())

POST_LOGIN_ACTIONS = _struct(
    url_id=T.StringType(),
    action_type=T.StringType(),
    selector=T.StringType(),
    value=T.StringType(),
)

CAPTURE_FIELDS = _struct(
    id=T.StringType(),
    url_id=T.StringType(),
    field_name=T.StringType(),
    field_value=T.StringType(),
    field_type=T.StringType(),
    selector=T.StringType(),
    ord=T.IntegerType(),
    required=T.BooleanType(),
    active=T.BooleanType(),
    created_at=T.TimestampType(),
    submit_selector=T.StringType(),
)

INVOICE_CLIENT = _struct(
    id=T.StringType(),
    invoice_id=T.LongType(),
    insurer_id=T.LongType(),
    doc_id=T.StringType(),
    first_name=T.StringType(),
    second_name=T.StringType(),
    first_surname=T.StringType(),
    second_surname=T.StringType(),
    policy_no=T.StringType(),
    dependent_no=T.StringType(),
    created_at=T.TimestampType(),
    status=T.ByteType(),
)

SCRAPE_RESULTS = _struct(
    id=T.LongType(),
    url=T.StringType(),
    title=T.StringType(),
    content=T.StringType(),
    status_code=T.IntegerType(),
    error_message=T.StringType(),
    rendered=T.BooleanType(),
    ts=T.TimestampType(),
    processing_time=T.DoubleType(),
    extracted=T.StringType(),
)

NAVIGATION_LOG = _struct(
    session_id=T.StringType(),
    ts=T.TimestampType(),
    attempt=T.IntegerType(),
    url=T.StringType(),
    title=T.StringType(),
    error_text=T.StringType(),
)

INBOX = _struct(delivery_tag=T.LongType(), body=T.BinaryType())

# The keys a message may carry, and our column for each.
MESSAGE_FIELDS = {
    "NombreCompleto": "insurer_name",
    "IdFactura": "invoice_id",
    "IdAseguradora": "insurer_id",
    "NumDocIdentidad": "doc_id",
    "PersonaPrimerNombre": "first_name",
    "PersonaSegundoNombre": "second_name",
    "PersonaPrimerApellido": "first_surname",
    "PersonaSegundoApellido": "second_surname",
    "FechaProcesamiento": "processed_on",
}
NAME_PARTS = ("first_name", "second_name", "first_surname", "second_surname")

# Longest text each invoice column can hold.
INVOICE_TEXT_LIMITS = {
    "doc_id": 25,
    "first_name": 20,
    "second_name": 20,
    "first_surname": 20,
    "second_surname": 20,
    "policy_no": 50,
    "dependent_no": 50,
}
