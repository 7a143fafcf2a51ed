"""tessera: document-intake analytics on PySpark, as plain DataFrame functions."""
