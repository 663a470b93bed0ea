"""Plans: findings, requirements, planner, rewrites and the compiler; and the query catalog."""
