"""Query plans over the driver tables: one Spark builder + one oracle SQL per key."""
