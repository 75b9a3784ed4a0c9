"""The dialect's front end: text to tokens to statements."""
