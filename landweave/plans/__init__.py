"""Plans that span tables: run lineage, design matrices, the database and its simulation loop."""
