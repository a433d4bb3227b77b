"""tamarack: agent-memory, rule-compliance and corpus analytics on PySpark."""
