"""Column names of the warehouse tables, in file order, and the record layout of the domain dump."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the unloaded tables.
TOKEN_TRANSFER = (
    "block_number block_timestamp tx_hash tx_position event_index from_address to_address contract_address "
    "token_standard token_is_verified name symbol decimals raw_amount_precise raw_amount amount_precise amount "
    "amount_usd origin_function_signature origin_from_address origin_to_address ez_token_transfers_id "
    "inserted_timestamp modified_timestamp"
).split()
NATIVE_TRANSFER = (
    "block_number block_timestamp tx_hash tx_position trace_index trace_address type from_address to_address amount "
    "amount_precise_raw amount_precise amount_usd origin_from_address origin_to_address origin_function_signature "
    "ez_native_transfers_id inserted_timestamp modified_timestamp"
).split()
ADDRESS_LABEL = (
    "blockchain creator address address_name label_type label_subtype label dim_labels_id inserted_timestamp "
    "modified_timestamp"
).split()
CONTRACT = (
    "address symbol name decimals created_block_number created_block_timestamp created_tx_hash creator_address "
    "dim_contracts_id inserted_timestamp modified_timestamp"
).split()

KINDS = {"token": TOKEN_TRANSFER, "native": NATIVE_TRANSFER, "label": ADDRESS_LABEL, "contract": CONTRACT}

_REF = T.StructType([T.StructField("id", T.StringType())])
ENS_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("owner", _REF),
    T.StructField("wrappedOwner", _REF),
])
