"""Plans: procedures composed of several operators."""
