"""The SQL front end over snapshots, and the catalogue of registered queries."""
