"""The moment that test messages count their seconds from."""

from datetime import datetime, timezone

T0 = datetime(2020, 2, 25, 8, 0, 0, tzinfo=timezone.utc)
T0_MS = 1582617600000
