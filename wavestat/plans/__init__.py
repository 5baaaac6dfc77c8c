"""The study's products as query plans, the query catalog and oracle SQL."""
