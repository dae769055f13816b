"""Table schemas and the fixed domain values of the delivery data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the modelled system for identical results)
# ---------------------------------------------------------------------------
# Delivery status, in lifecycle order.
ORDER_STATUSES = ["CONFIRMED", "PREPARING", "READY_FOR_PICKUP", "PICKED_UP", "IN_TRANSIT", "DELIVERED"]
FINAL_STATUS = "DELIVERED"
READY_STATUS = "READY_FOR_PICKUP"
# Courier vehicle kinds.
VEHICLE_TYPES = ["BIKE", "MOTORCYCLE", "CAR"]
# varchar limits: names and emails 255, phone 20, kitchen type 100.
NAME_MAX_LEN = 255
EMAIL_MAX_LEN = 255
PHONE_MAX_LEN = 20
KITCHEN_TYPE_MAX_LEN = 100
# Mean earth radius in metres used for great-circle distances.
EARTH_RADIUS_M = 6_371_009.0
# Messages per receive call of the GPS queue (the in-batch dedup unit).
RECEIVE_BATCH_SIZE = 10
# Message retention of the GPS queue, seconds (bounds redelivery).
QUEUE_RETENTION_SECONDS = 300
# Reject reasons.
REASON_FINAL = "Delivery already reached the final status."
REASON_TRANSITION = "Invalid delivery status transition. Expected {expected}."
REASON_DUP_ITEM = "Duplicated item in order payload."
REASON_ITEM_NOT_IN_RESTAURANT = "Item not found for the informed restaurant."
REASON_RESTAURANT_NOT_FOUND = "Restaurant not found."
REASON_USER_NOT_FOUND = "User not found."
REASON_ORDER_NOT_FOUND = "Order not found."
REASON_COURIER_NOT_FOUND = "Courier not found."
REASON_DELIVERY_NOT_FOUND = "Delivery not found."
REASON_KITCHEN_NOT_FOUND = "Kitchen type not found."
REASON_ORDER_HAS_DELIVERY = "Order already has an associated delivery."
REASON_COURIER_BUSY = "Courier is currently busy with another delivery."
REASON_ITEM_NOT_FOUND = "Item not found."
REASON_KITCHEN_MISSING = "Kitchen not found."
REASON_CONFLICT = "{entity} already exists or payload violates constraints."
REASON_NO_ITEMS = "Order must contain at least one item."
REASON_BAD_QUANTITY = "Item quantity must be at least 1."

# ---------------------------------------------------------------------------
# Logical table schemas
# ---------------------------------------------------------------------------
ENTITY_DDL = {
    "region": "id INT NOT NULL, name STRING NOT NULL",
    "users": "id BIGINT NOT NULL, email STRING NOT NULL, name STRING NOT NULL, house_lat DOUBLE NOT NULL, house_lon DOUBLE NOT NULL, region_id INT",
    "phones": "user_id BIGINT NOT NULL, phone STRING NOT NULL",
    "kitchen_type": "id INT NOT NULL, type STRING NOT NULL",
    "restaurant": "id BIGINT NOT NULL, name STRING NOT NULL, lat DOUBLE, lon DOUBLE, kitchen_type_id INT NOT NULL, region_id INT",
    "item": "id BIGINT NOT NULL, name STRING NOT NULL, price DECIMAL(10,2) NOT NULL, restaurant_id BIGINT NOT NULL",
    "courier": "id BIGINT NOT NULL, name STRING NOT NULL, vehicle STRING NOT NULL, lat DOUBLE, lon DOUBLE, region_id INT",
    "orders": "id BIGINT NOT NULL, restaurant_id BIGINT NOT NULL, user_id BIGINT NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
    "order_item": "order_id BIGINT NOT NULL, item_id BIGINT NOT NULL, quantity INT NOT NULL",
    "delivery": "id BIGINT NOT NULL, order_id BIGINT NOT NULL, courier_id BIGINT NOT NULL",
    "event": "id BIGINT NOT NULL, status STRING NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL, delivery_id BIGINT NOT NULL",
    "node": "id BIGINT NOT NULL, lat DOUBLE NOT NULL, lon DOUBLE NOT NULL",
    "edge": "u BIGINT NOT NULL, v BIGINT NOT NULL, length DOUBLE NOT NULL",
}


def entity_schema(name: str) -> T.StructType:
    """Declared schema of a logical table (needs a running session)."""
    return T.StructType.fromDDL(ENTITY_DDL[name])


EVENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
    T.StructField("delivery_id", T.LongType(), False),
])


# Raw queue message as it lands in files or a Kafka value: one JSON body.
RAW_MESSAGE = T.StructType([
    T.StructField("message_id", T.LongType(), True),
    T.StructField("body", T.StringType(), True),
])

# JSON body of a GPS message; both the queue shape (lat/lng, epoch-millis
# timestamp) and the API shape (lat_courier/lon_courier, ISO timestamp).
MESSAGE_BODY = T.StructType([
    T.StructField("courier_id", T.StringType(), True),
    T.StructField("delivery_id", T.StringType(), True),
    T.StructField("lat", T.StringType(), True),
    T.StructField("lng", T.StringType(), True),
    T.StructField("lat_courier", T.StringType(), True),
    T.StructField("lon_courier", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
])
