"""Texts that every operator has to take."""

#: Every operator has to take these: null, empty, blank, repeated, odd and long texts.
ODD = [None, "", " \n\t", "one", "a b", "a b c d e f g h i j k l", "Émile \U0001f600 naïve\x00nul", "Zeile\r\nzwei\n\n  x  y ", "w " * 3000, "Released under the MIT License.\nReleased under the MIT License."]
