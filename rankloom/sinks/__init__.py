"""Writers of facts, queues and payloads."""
