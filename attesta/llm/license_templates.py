"""Licence wordings as templates with markup.

``<<optional>> .. <<end>>`` may be left out; ``<<words m-n>>`` stands for m to n words of any kind; ``<<one of a|b>>`` for one
of the words named. All else must stand as it is, in words of letters and digits, lower-cased.
"""

# Public licence wordings.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

_WARRANTY = (
    "the software is provided as is <<optional>> without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement <<end>> in no event shall the <<words 1-12>> "
    "be liable for any claim damages or other liability")
_REDISTRIBUTION = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met <<words 0-1>> redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer <<words 0-1>> redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution")
_GNU = (
    "under the terms of <<optional>> version 2 of <<end>> the gnu {name} <<optional>> as published by the free software "
    "foundation <<end>> <<optional>> either <<end>> version {version}")

TEMPLATES = {
    "apache-2.0": [
        "licensed <<optional>> to <<words 1-12>> <<end>> under the <<optional>> terms of the <<end>> apache license version 2 0",
        "spdx license identifier apache 2 0"],
    "bsd-2-clause": [_REDISTRIBUTION + " this software is provided by <<words 1-12>> as is", "spdx license identifier bsd 2 clause"],
    "bsd-3-clause": [
        _REDISTRIBUTION + " <<words 0-1>> neither the name of <<words 1-16>> nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission",
        "spdx license identifier bsd 3 clause"],
    "cc-by-4.0": ["licensed under <<optional>> a <<end>> cc by 4 0",
                  "creative commons attribution 4 0 international <<optional>> public <<end>> license"],
    "cc-by-nc-4.0": ["licensed under <<optional>> a <<end>> cc by nc 4 0",
                     "creative commons attribution <<one of noncommercial|nc>> 4 0 international <<optional>> public <<end>> license"],
    "cc-by-sa-4.0": ["licensed under <<optional>> a <<end>> cc by sa 4 0",
                     "creative commons attribution <<one of sharealike|sa>> 4 0 international <<optional>> public <<end>> license"],
    "gpl-2.0": [_GNU.format(name="general public license", version="2"),
                "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0"],
    "gpl-3.0": [_GNU.format(name="general public license", version="3"),
                "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0"],
    "isc": ["permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": [_GNU.format(name="<<one of lesser|library>> general public license", version="<<one of 2|3>>")],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
            "<<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the "
            "software " + _WARRANTY,
            "<<one of released|licensed|distributed|available>> under the <<optional>> terms of the <<end>> <<optional>> permissive <<end>> mit license",
            "spdx license identifier mit"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
                "<<words 1-3>> you can obtain one at", "spdx license identifier mpl 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
                  "compile sell or distribute this software"],
}
