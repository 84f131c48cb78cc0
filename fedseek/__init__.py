"""fedseek: federated keyword search over tabular sources, written for Spark."""
