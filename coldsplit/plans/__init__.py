"""End-to-end plans: fixtures on the driver's tables and the query registry."""
